"""Conversations as token ids with a loss mask, assembled from segments that are encoded apart from each other.

Each text is encoded by itself, where it lies; marks between texts are reserved ids above the vocabulary's, so that no
text can make one. Conversations are then spliced from ids alone. A segment's place is the prefix sum of the
lengths before it, and the mask that of a plus one where a learnt text begins and a minus one behind it.

As text, a mark is a control string. Those in a text get a backslash more after their first letter, and
one less when read back, so that `</s>` becomes `<\\/s>` and `<\\/s>` becomes `<\\\\/s>`.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import ByteBpe
from tidemark.llm.shared import small_batches, text_of

#: The template's control strings; the k-th has the k-th id behind the vocabulary's.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[ROLE]", "[/ROLE]", "[END]")
#: What opens and closes a turn of a role; all others are written out between [ROLE] and [/ROLE].
FRAMES = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[OUT]", "</s>")}
OTHER = ("[ROLE]", "[END]")
LEARNT = "assistant"
#: Tokens of a conversation that are held before a row of them is given out, at the end of a turn.
HELD = 1 << 16

FORMATTED = "conv_id long, chunk long, start long, input_ids array<int>, loss_mask array<boolean>"
TURNS = "conv_id long, chunk long, k long, role string, text string, loss_text string, chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Template:
    """Ids of a byte-level vocabulary with MARKS behind it, and the bytes of each id at its place in one long string."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        named = {i: s.encode() for s, i in self.bpe.special.items()}
        self.base = max([self.bpe.bpe.max_token_value, *named]) + 1
        parts = [named.get(i) or self._bytes(i) for i in range(self.base)]
        self.length = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.mark = {m: self.base + k for k, m in enumerate(MARKS)}
        self.control = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in (*MARKS, *self.bpe.special)))

    def _bytes(self, i: int) -> bytes:
        try:
            return self.bpe.bpe.decode_single_token_bytes(i)
        except KeyError:  # no token has this id
            return b""

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text

    def unescape(self, text: str) -> str:
        return self.control.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text) if "\\" in text else text

    def encode(self, text: str) -> bytes:
        """Ids of the escaped text as packed little-endian 32-bit integers."""
        return self.bpe.encode(self.escape(text))

    def decode(self, ids: np.ndarray) -> str:
        """The escaped text of ids, by gathering each id's bytes from its place."""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.begin[ids] - ends + n, n)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def encoded(turns: DataFrame, path: str) -> DataFrame:
    """(conv_id, turn, role, ids, role_ids) of turns (conv_id, turn, role, text): each text's ids, and the role's where it has no marks of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        for b in batches:
            ids = pa.array([t.encode(x) for x in b["text"].to_pylist()], pa.binary())
            named = pa.array([b"" if r in FRAMES else t.encode(r) for r in b["role"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], ids, named], ["conv_id", "turn", "role", "ids", "role_ids"])

    return turns.mapInArrow(run, "conv_id long, turn long, role string, ids binary, role_ids binary")


def masked(lengths: list[int], learnt: list[bool]) -> np.ndarray:
    """The mask over segments of these lengths: one where a learnt segment is, by prefix sums."""
    ends = np.cumsum(np.array(lengths, np.int64))
    own = np.array(learnt, bool)
    step = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(step, (ends - lengths)[own], 1)
    np.add.at(step, ends[own], -1)
    return np.cumsum(step[:-1]) > 0


def formatted(conversations: DataFrame, path: str, held: int = HELD) -> DataFrame:
    """FORMATTED rows of conversations (conv_id, turn, role, text): a row for each conversation, more for one of over held tokens, cut between turns.

    Turns go by turn, then role, then ids; a null turn comes first. A null text or role is an empty one, rows of a null conv_id are one conversation, repeated
    rows are turns each. Other columns don't count. Texts are encoded before they move; a long conversation's ids go through one task, held tokens and a batch at a time.
    """
    small_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = encoded(turns, path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        mark = {m: np.array([i], "<u4").tobytes() for m, i in t.mark.items()}
        now, chunk, start, size = object(), 0, 0, 0
        parts, learnt = [], []
        ready: list[tuple] = []

        def cut() -> None:
            nonlocal chunk, start, size, parts, learnt
            if parts:
                lengths = [len(p) // 4 for p in parts]
                ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                ready.append((now, chunk, start, ids, masked(lengths, learnt)))
                chunk, start, size, parts, learnt = chunk + 1, start + len(ids), 0, [], []

        for b in batches:
            for conv, role, ids, named in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["ids"].to_pylist(), b["role_ids"].to_pylist(), strict=True):
                if conv != now:
                    cut()
                    now, chunk, start = conv, 0, 0
                    parts, learnt = [mark["<s>"]], [False]
                opens, closes = FRAMES.get(role, OTHER)
                parts += [mark[opens], *([] if role in FRAMES else [named, mark["[/ROLE]"]]), ids, mark[closes]]
                learnt += [False] * (len(parts) - len(learnt))
                learnt[-2] = role == LEARNT
                size += 4 * len(MARKS) + len(ids) + len(named)
                if size >= 4 * held:
                    cut()
            if ready:
                yield _rows(ready)
                ready.clear()
        cut()
        if ready:
            yield _rows(ready)

    return rows.mapInArrow(run, FORMATTED)


def _rows(ready: list[tuple]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *(len(r[3]) for r in ready)]), pa.int32())
    ids, mask = (np.concatenate([r[k] for r in ready]) for k in (3, 4))
    columns = [pa.array([r[k] for r in ready], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(mask))], ["conv_id", "chunk", "start", "input_ids", "loss_mask"])


def turns_of(rows: DataFrame, path: str) -> DataFrame:
    """TURNS of FORMATTED rows, in their order: role and text by the marks, loss_text by the mask, chars of all of a turn's ids as text, with marks and escapes."""
    roles = {opens: role for role, (opens, _) in FRAMES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        for b in batches:
            out: list[tuple] = []
            for conv, chunk, ids, mask in zip(b["conv_id"].to_pylist(), b["chunk"].to_pylist(), b["input_ids"], b["loss_mask"], strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(ids >= t.base)
                names = [MARKS[i - t.base] for i in ids[at]]
                j = k = 0
                while j < len(at):
                    first = j
                    j += names[j] == "<s>"
                    role, other = roles.get(names[j]), ""
                    if role is None:
                        other = t.decode(ids[at[j] + 1 : at[j + 1]])
                        role, j = t.unescape(other), j + 1
                    a, e = at[j] + 1, at[j + 1]
                    text = t.decode(ids[a:e])
                    learnt = t.decode(ids[a:e][mask[a:e]])
                    out.append((conv, chunk, k, role, t.unescape(text), t.unescape(learnt), len(text) + len(other) + sum(map(len, names[first : j + 2]))))
                    j, k = j + 2, k + 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [c.split()[0] for c in TURNS.split(", ")])

    return rows.mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """DIGESTS of TURNS rows, those of a conversation following each other in order; a digest is carried from turn to turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        names, kinds = zip(*(c.split() for c in DIGESTS.split(", ")), strict=True)
        ready: list[tuple] = []

        def end() -> None:
            if state:
                n, sha, chars, loss, total = state
                ready.append((now, n, sha.hexdigest(), chars, loss.hexdigest(), total))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, kind in zip(zip(*ready, strict=True), kinds, strict=True)], list(names))

        for b in batches:
            for conv, role, text, learnt, chars in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text", "loss_text", "chars")), strict=True):
                if conv != now:
                    end()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += chars
            if ready:
                yield rows()
                ready.clear()
        end()
        if ready:
            yield rows()

    return turns.mapInArrow(run, DIGESTS)


def read_back(rows: DataFrame, path: str) -> DataFrame:
    """DIGESTS of FORMATTED rows in any order: all that they say is read off ids and mask."""
    in_order = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return digests(turns_of(in_order, path))
