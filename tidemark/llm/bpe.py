"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

For a word an Aho-Corasick automaton gives the longest entry of the vocabulary at each place, and a table the next shorter entry
that it begins with. The encoder takes the longest entry at a place that is compatible with the token before it: two neighbours are compatible if merging
their joint text by rank gives just these two. A dead end takes the last token back and tries the
next shorter one; each place is left at most once, so time is linear in the word. Compatible
neighbours all along make the one result that merging by rank gives.

The vocabulary is that of a tokenizers file whose words end in a marked last character: texts are
NFC-normalised, white space is dropped, letters lower-cased, words split by a pattern.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers
from tokenizers.pre_tokenizers import Split

from tidemark.llm.shared import small_batches, text_of

#: Fixed value: white space as Unicode defines it.
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters outside these well-known ranges are looked up among the rare ones.
UNCOMMON = re.compile("[^\x00-\u02ff\u0400-\u0481\u2010-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]")
#: Different words whose codes a task remembers, up to this many characters each, and pairs of tokens known to fit or not.
REMEMBERED, SHORT, PAIRS = 600_000, 64, 1_000_000
WORD_END = ""


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


def ranges(letters: Iterable[str]) -> str:
    """A pattern's class of these characters, without its brackets."""
    out: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.cache
def every_character() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


@functools.cache
def unknown_characters() -> str:
    """Characters that Python's Unicode tables don't have; newer tables may."""
    return "".join(c for c in every_character() if unicodedata.category(c) == "Cn")


@functools.cache
def moved_marks() -> str:
    """Marks that the library's tables put in another order beside a mark above, below, inside or under than Python's do."""
    marks = [c for c in every_character() if unicodedata.category(c)[0] == "M"]
    nfc = normalizers.NFC().normalize_str
    return "".join(c for c in marks if any(nfc(x) != unicodedata.normalize("NFC", x) for p in "\u0307\u0323\u0334\u0345" for x in (c + p, p + c)))


@functools.cache
def open_characters(kind: str) -> str:
    """Characters that are letters (kind L) or numbers (N) in the regex module's version of Unicode or in Python's, not in both."""
    newer = set(regex.findall(rf"\p{{{kind}}}", every_character()))
    return "".join(sorted(newer ^ {c for c in every_character() if unicodedata.category(c)[0] == kind}))


def class_of(kind: str) -> str:
    """The class of letters (kind L) or numbers (N) as the tokenizers library has it, for a pattern of nested sets.

    This library's tables, the regex module's and Python's are of different versions of Unicode. Where the last two agree so does
    the first, which lies between them; on the others it is asked.
    """
    open_ = open_characters(kind)
    left = {c for piece, _ in Split(Regex(rf"\p{{{kind}}}"), "removed").pre_tokenize_str(open_) for c in piece} if open_ else set()
    newer = set(regex.findall(rf"\p{{{kind}}}", open_))
    out, more = newer & left, set(open_) - left - newer
    return rf"[[\p{{{kind}}}" + (f"--[{ranges(out)}]" if out else "") + "]" + (f"[{ranges(more)}]" if more else "") + "]"


class WordBpe(dict):
    """Vocabulary and merges of a file; as a dict, the packed ids of words and other pieces met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.exact_pattern = regex.compile(pattern.replace(r"\p{L}", class_of("L")).replace(r"\p{N}", class_of("N")), regex.V1)
        self.rare = re.compile(f"[{ranges(set(unknown_characters() + moved_marks() + open_characters('L') + open_characters('N')))}]")
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        marked = {t: (t[: -len(self.suffix)] + WORD_END if t.endswith(self.suffix) else t) for t in model["vocab"]}
        self.ids = {m: model["vocab"][t] for t, m in marked.items()}
        self.rank, self.parts = {}, {}
        for n, (a, b) in enumerate(model["merges"]):
            a, b, both = marked[a], marked[b], marked[a + b]
            self.rank[self.ids[a], self.ids[b]] = n
            self.parts[self.ids[both]] = (self.ids[a], self.ids[b])
        self.made = {p: self.rank[ab] for p, ab in self.parts.items()}
        self.automaton = ahocorasick.Automaton()
        for m, i in self.ids.items():
            self.automaton.add_word(m, (len(m), i))
        self.automaton.make_automaton()
        self.length = {i: len(m) for m, i in self.ids.items()}
        self.shorter = {i: next((self.ids[m[:k]] for k in range(len(m) - 1, 0, -1) if m[:k] in self.ids), None) for m, i in self.ids.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        names = [(self.names.get(i, "") + " ").encode() for i in range(max(self.names) + 1)]
        self.offsets = np.cumsum([0] + [len(x) for x in names])
        self.blob = np.frombuffer(b"".join(names), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint text of a and b by rank leaves just a and b: no merge across the border comes before those that make them."""
        fit = self.fits.get((a, b))
        if fit is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[a, b] = fit = self._compatible(a, b)
        return fit

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of both sides from the latest on; at each state, the pieces at the border may merge only later than the merge undone last.
        until = len(self.rank)
        while True:
            if self.rank.get((a, b), until) < until:
                return False
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, self.parts[a][1]
            else:
                until, b = rb + 1, self.parts[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word in the vocabulary's letters, its last one marked.

        One run of the automaton gives the longest token that begins at each place: of the tokens that end at a place the longest
        comes first, and a later end at the same beginning is a longer token.
        """
        end = len(word)
        longest: list[int | None] = [None] * end
        for last, (n, i) in self.automaton.iter(word):
            longest[last - n + 1] = i
        length, shorter, compatible = self.length, self.shorter, self.compatible
        out: list[int] = []
        dead = bytearray(end + 1)
        start, before, i = 0, None, longest[0]
        while start < end:
            while i is not None and (dead[start + length[i]] or before is not None and not compatible(before, i)):
                i = shorter[i]
            if i is not None:
                out.append(i)
                start, before = start + length[i], i
                i = longest[start] if start < end else None
            else:
                if not out:
                    raise ValueError(f"no encoding of {word[:100]!r}")
                dead[start] = 1
                taken = out.pop()
                start -= length[taken]
                before, i = out[-1] if out else None, shorter[taken]
        return out

    def word(self, word: str) -> bytes:
        """Packed ids of a word of normalised text."""
        packed = self.get(word)
        if packed is None:
            ids = self.encode_word(word.encode().decode("latin-1").translate(self.letters) + WORD_END)
            packed = self.remember(word, struct.pack(f"<{len(ids)}I", *ids))
        return packed

    def __missing__(self, chunk: str) -> bytes:
        """Packed ids of a piece of normalised text without blanks: of its words, which mostly are itself, or itself without one sign at the end."""
        if chunk.isalpha():
            return self.word(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,!?":
            return self.remember(chunk, self.word(chunk[:-1]) + self.word(chunk[-1]))
        pattern = self.exact_pattern if self.has_rare(chunk) else self.pattern
        return self.remember(chunk, b"".join(map(self.word, pattern.findall(chunk))))

    def remember(self, chunk: str, packed: bytes) -> bytes:
        if len(chunk) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = packed
        return packed

    def has_rare(self, text: str) -> bool:
        """Whether tables of different versions of Unicode may disagree on a character of the text."""
        return not text.isascii() and UNCOMMON.search(text) is not None and self.rare.search(text) is not None

    def normalised(self, text: str) -> str:
        """NFC, white space as one blank, lower case; by the tokenizers library if the text has characters that Python doesn't know or orders otherwise."""
        if self.has_rare(text):
            return self.normalizer.normalize_str(text)
        return BLANKS.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; special tokens in it count as such."""
        parts = self.cut.split(text) if self.cut and "<" in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.append(b"".join(map(self.__getitem__, self.normalised(part).split(" "))))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """The tokens' names with blanks between, in UTF-8: spans of one buffer, found by the offset table."""
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return b""
        starts, n = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        ends = np.cumsum(n)
        return self.blob[np.arange(ends[-1]) + np.repeat(starts - (ends - n), n)].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): each whole text's ids as packed little-endian 32-bit integers, and the text that they decode to.

    A null or blank text has no ids. Repeated rows are encoded each; other columns don't matter.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.binary()), pa.array([bpe.decode(x).decode() for x in ids], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row; ids and decoded texts don't leave their task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch["t"].to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
