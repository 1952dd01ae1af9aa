"""Order-preserving packing: dynamic programming over cuts at document and sentence boundaries.

Documents in id order make one stream of tokens, which is cut into windows of at most WINDOW tokens.
A cut costs nothing between documents, a little between sentences and more inside one; a window's
padding costs one per token. With c(i) the least cost of a stream that ends at cut i, the next cut j
at place p(j) has c(j) = cost of cut j + WINDOW - p(j) + least of c(i) + p(i) over the cuts i at most
WINDOW before it: a sliding minimum, which a queue of rising values keeps in linear time.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters
from tidemark.llm.shared import small_batches, text_of

WINDOW = 2048
#: Costs of a cut between sentences and inside one, in tokens of padding.
SENTENCE_CUT, INNER_CUT = 2, 8
#: Inside sentences a cut may be at every STEPth token.
STEP = 16
#: Tokens that are gathered before windows are cut; all but the last window are then given out.
HORIZON = 1 << 18
REMEMBERED, SHORT = 400_000, 64
#: A text with a blank between white space, where pieces of a text aren't those of its words.
WIDE_BLANKS = re.compile(r"\s (?:\s|\Z)")


class ByteBpe(dict):
    """A byte-level vocabulary of a tokenizers file; as a dict, the packed ids of words met so far, each with the blank before it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        # Fixed value: the pattern that byte-level pre-tokenizing splits by.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bpe = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        packed = self.plain(" " + word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian 32-bit integers; special tokens in it count as such."""
        if self.cut and "<" in text and len(parts := self.cut.split(text)) > 1:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._part(p) for k, p in enumerate(parts))
        return self._part(text)

    def _part(self, text: str) -> bytes:
        if not text or WIDE_BLANKS.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))

    @functools.cached_property
    def sentence_ends(self) -> np.ndarray:
        """For each id, whether it ends in a full stop, question or exclamation mark or a line break."""
        ends = np.zeros(max(self.special.values(), default=0) + len(self.bpe.token_byte_values()) + 2, bool)
        for i in range(self.bpe.max_token_value + 1):
            try:
                ends[i] = self.bpe.decode_single_token_bytes(i).endswith((b".", b"?", b"!", b"\n"))
            except KeyError:
                continue
        return ends


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """The places of the cheapest cuts of a stream that ends at the last place. places: where cuts may be, rising; costs: of each.

    Where the next place is more than a window away, an inner cut stands at the end of the full window.
    """
    c, at, back = [0.0], [0], [-1]
    queue: deque[int] = deque([0])
    for p, cost in zip(places.tolist(), costs.tolist(), strict=True):
        while p - at[-1] > window:  # a stretch without places: cut inside
            _advance(c, at, back, queue, at[-1] + window, INNER_CUT, window)
        _advance(c, at, back, queue, p, cost, window)
    cuts, i = [], len(at) - 1
    while i > 0:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1]


def _advance(c: list, at: list, back: list, queue: deque, p: int, cost: float, window: int) -> None:
    while at[queue[0]] < p - window:
        queue.popleft()
    i = queue[0]
    c.append(c[i] + at[i] + cost + window - p)
    at.append(p)
    back.append(i)
    value = c[-1] + p
    while queue and c[queue[-1]] + at[queue[-1]] >= value:
        queue.pop()
    queue.append(len(at) - 1)


def powers(start: int, end: int) -> list[int]:
    """Cuts of the last stretch: into powers of two, the largest first, which need no padding."""
    cuts = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        cuts.append(start)
    return cuts


class Packer:
    """Takes documents one by one and gives out pieces; holds at most HORIZON tokens and one document."""

    def __init__(self, bpe: ByteBpe, window: int, part: int):
        self.bpe, self.window, self.next = bpe, window, part << 40
        self.docs: deque[tuple[int, int, int]] = deque()  # id, tokens in all, tokens given out
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int, text: str, end: int) -> None:
        ids = np.frombuffer(self.bpe.encode(text) + np.array([end], "<u4").tobytes(), "<u4")
        self.docs.append((doc_id, len(ids), 0))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= HORIZON:
            self.flush(False)

    def flush(self, last: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        ends = np.cumsum([n - given for _, n, given in self.docs])
        cost = np.where(self.bpe.sentence_ends[ids], SENTENCE_CUT, -1)
        cost[STEP - 1 :: STEP] = np.where(cost[STEP - 1 :: STEP] < 0, INNER_CUT, cost[STEP - 1 :: STEP])
        cost[ends - 1] = 0
        places = np.flatnonzero(cost >= 0)
        cuts = best_cuts(places + 1, cost[places], self.window)
        cuts.pop()
        if last:
            cuts += powers(cuts[-1] if cuts else 0, len(ids))
        start = 0
        for cut in cuts:
            offset = 0
            while start < cut:
                doc_id, n, given = self.docs[0]
                take = min(n - given, cut - start)
                self.rows.append((doc_id, given, take, zlib.crc32(ids[start : start + take].tobytes()), n, self.next, offset))
                start, offset = start + take, offset + take
                if given + take == n:
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc_id, n, given + take)
            self.next += 1
        self.ids, self.held = ([ids[start:]], len(ids) - start) if start < len(ids) else ([], 0)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], schema=SCHEMA)


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (null text: none) are followed by the id end. The ids are dealt into ranges of the document id, one
    range to a task, and packed in order there, a range's last window is cut into powers of two, which need no padding. Each id lies in
    one piece; a null id counts as the least one, and repeated rows are packed each.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(loaded(path), window, TaskContext.get().partitionId())
        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["t"].to_pylist(), strict=True):
                packer.add(i, t, end)
            if packer.rows:
                yield packer.take()
        packer.flush(True)
        yield packer.take()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "t")
    kinds = ", ".join(f"{n} long" for n in SCHEMA.names)
    return ordered.mapInArrow(run, kinds).withColumnRenamed("doc_id", id_col)
