"""Removal of byte strings that repeat across documents, by content-defined anchors and sorted runs of windows.

Sorting every suffix of a corpus moves many times its size (README, "Method not as named"). Here hashes of stretches are sorted instead. Of the K-byte
strings inside a window of LENGTH bytes, the leftmost one of the least hash is the window's anchor, so that equal
windows have their anchor at the same place. Neighbouring windows mostly share an anchor; such windows
together are a run. About one byte in 15 begins an anchor. Bytes are never compared: stretches count as equal if their hashes do.

1. A tuple (anchor, run, document) for each run goes through Spark's external sort, which spills to disk
   and merges there. A run that also is in a smaller document is wholly repeated. Runs whose anchor is
   shared while the run differs may have windows in common.
2. Only for these, the bytes of the run go through a second sort; each of its windows is compared with those
   of the other runs of its anchor. An anchor with more than HOT runs (the edge of a very common passage)
   has its windows sorted on their own, so that no group is held in memory.
3. Each document finds its repeated windows by its runs' verdicts and drops the bytes they cover.

No document is sorted in one task, and every step streams over sorted tuples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches, text_of, written

LENGTH = 50
K = 20
HOT = 20_000
#: Windows of a document that are looked at together; their places fit in 16 bits.
SEGMENT = 1 << 16
#: Bytes of runs whose windows a task compares at once, beyond one anchor's.
BUFFER = 1 << 20
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
FULL, PART, SPLIT = 1, 2, 3


class _Powers:
    up = down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_Powers.up) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            setattr(_Powers, name, np.cumprod(x))
    return _Powers.up, _Powers.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows: see stretch."""
    _, down = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * down[: len(data)], out=c[1:])
    return c


def stretch(c: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
    return (c[end] - c[start]) * _Powers.up[at]


def runs(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(anchor hash of 48 bits, run hash, first window, windows) of a text of at most SEGMENT windows.

    A run hash stands for the bytes of its windows and the anchor; its two lowest bits are free.
    """
    n, w = len(data), length - k + 1
    c = sums(data)
    m = n - k + 1
    h = mix(stretch(c, slice(0, m), slice(k, n + 1), slice(0, m))) >> np.uint64(16)
    x = (h << np.uint64(16)) | np.arange(m, dtype=np.uint64) if m <= 1 << 16 else None
    if x is None:
        raise ValueError("a segment is too long")
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    count = np.diff(np.concatenate([first, [len(x)]]))
    head = x[first]
    anchor, place = head >> np.uint64(16), (head & np.uint64(0xFFFF)).astype(np.int64)
    body = stretch(c, first, first + count + length - 1, first)
    run = mix(body ^ mix(anchor + (count.astype(np.uint64) << np.uint64(8)) + (place - first).astype(np.uint64))) & ~np.uint64(3)
    return anchor.astype(np.int64), run.view(np.int64), first, count


def segments(data: np.ndarray, length: int = LENGTH, k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a text that together have each of its windows once."""
    windows, size = len(data) - length + 1, SEGMENT - length + k
    for start in range(0, windows, size):
        yield start, data[start : min(start + size, windows) + length - 1]


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _joined(parts: list[np.ndarray], dtype: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, run, doc): of equal runs in a batch the smallest document's; the others are known to be repeated, and have anchor -1."""
    for batch in batches:
        parts = []
        for doc, text in zip(batch["id"].to_pylist(), batch["t"].to_pylist(), strict=True):
            for _, data in segments(bytes_of(text)):
                anchor, run, _, _ = runs(data)
                parts.append((anchor, run, np.full(len(run), doc, np.int64)))
        if not parts:
            continue
        anchor, run, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, run))
        anchor, run, doc = anchor[order], run[order], doc[order]
        same = run[1:] == run[:-1]
        new = np.concatenate([[True], ~(same & (doc[1:] == doc[:-1]))])
        least = np.concatenate([[True], ~same])
        least_doc = doc[np.maximum.accumulate(np.where(least, np.arange(len(run)), 0))]
        anchor = np.where(doc == least_doc, anchor, -1)
        yield _batch(["anchor", "run", "doc"], anchor[new], run[new], doc[new])


def _later(run: np.ndarray, new: np.ndarray, doc: np.ndarray, least: int = 0) -> tuple[np.ndarray, int]:
    """Whether each tuple's document is larger than the least one of its run, and the last run's least. new: where a run begins; least: of a run that began before."""
    at = np.maximum.accumulate(np.where(new, np.arange(len(run)), -1))
    leasts = np.where(at < 0, least, doc[at])
    return doc > leasts, int(leasts[-1])


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key) from tuples in order: key is the run and, in its lowest bits, FULL, PART or SPLIT. Runs of an unshared anchor have no verdict."""
    held = [np.empty(0, np.int64)] * 3
    hot, hot_run, hot_doc = -2, 0, 0

    def closed(anchor: np.ndarray, run: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        """Verdicts of whole anchors."""
        known = again = anchor < 0
        if len(run):
            new = np.concatenate([[True], (run[1:] != run[:-1]) | (anchor[1:] != anchor[:-1])])
            again, _ = _later(run, new, doc)
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(run) else np.empty(0, np.int64)
        several = np.zeros(len(run), bool)
        if len(starts):
            owner = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(run)]])))
            many = np.add.reduceat(new.astype(np.int64), starts) > 1
            docs = np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts)
            several = (many & docs)[owner]
        verdict = np.where(known | again, FULL, np.where(several, PART, 0))
        keep = verdict > 0
        return _batch(["doc", "key"], doc[keep], run[keep] | verdict[keep])

    for batch in batches:
        held = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("anchor", "run", "doc"), strict=True)]
        if not len(held[0]):
            continue
        if hot == held[0][0]:  # the rest of an anchor that is split
            n = int(np.searchsorted(held[0], hot, "right"))
            new = np.concatenate([[held[1][0] != hot_run], held[1][1:n] != held[1][: n - 1]])
            again, hot_doc = _later(held[1][:n], new, held[2][:n], hot_doc)
            hot_run = held[1][n - 1]
            yield _batch(["doc", "key"], held[2][:n], held[1][:n] | np.where(again, FULL, SPLIT))
            held = [h[n:] for h in held]
            if not len(held[0]):
                continue
        n = int(np.searchsorted(held[0], held[0][-1], "left"))
        yield closed(*(h[:n] for h in held))
        held = [h[n:] for h in held]
        if len(held[0]) > HOT:
            hot, hot_run = held[0][0], held[1][-1]
            if hot < 0:
                yield closed(*held)
            else:
                again, hot_doc = _later(held[1], np.concatenate([[True], held[1][1:] != held[1][:-1]]), held[2])
                yield _batch(["doc", "key"], held[2], held[1] | np.where(again, FULL, SPLIT))
            held = [h[:0] for h in held]
    yield closed(*held)


def _window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    c = sums(data)
    return mix(stretch(c, starts, starts + LENGTH, starts))


def _doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, doc, run, first, body) of runs with verdict PART or SPLIT: a group is an anchor (body: the run's bytes) or a window."""
    schema = pa.schema([("group", pa.int64()), ("split", pa.bool_()), ("doc", pa.int64()), ("run", pa.int64()), ("first", pa.int32()), ("body", pa.binary())])
    for batch in batches:
        out: list[tuple] = []
        windows: dict[int, list] = {}
        for doc, text, keys in zip(batch["id"].to_pylist(), batch["t"].to_pylist(), batch["keys"], strict=True):
            keys = np.asarray(keys.values.to_numpy())
            seen: set[int] = set()
            for _, data in segments(bytes_of(text)):
                anchor, run, first, count = runs(data)
                part, split = np.isin(run | PART, keys), np.isin(run | SPLIT, keys)
                for j in np.flatnonzero(part | split):
                    r, a, n = int(run[j]), int(first[j]), int(count[j])
                    if r in seen:
                        continue
                    seen.add(r)
                    body = data[a : a + n + LENGTH - 1]
                    if part[j]:
                        out.append((int(anchor[j]), False, doc, r, 0, body.tobytes()))
                    else:
                        for i, g in enumerate(_window_hashes(body, np.arange(n)).view(np.int64).tolist()):
                            windows.setdefault(g, []).append((doc, r, i))
        for g, rows in windows.items():  # of equal windows in a batch only the smallest document's meets the others'; group -1: known to be repeated
            least = min(rows)[0]
            out += [(g, True, d, r, i, None) if d == least else (d, True, d, r, -1 - i, None) for d, r, i in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, run, mask) from doubtful runs in the order of split, group, doc: bit i of mask says that window i is repeated."""
    held: list[tuple[int, int, int, bytes]] = []
    size, split_group, split_doc = 0, None, 0

    def compared(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        group, doc, run = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        n = np.array([len(r[3]) for r in rows], np.int64)
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        count = n - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), count)
        firsts = np.cumsum(count) - count
        bit = np.arange(len(owner)) - firsts[owner]
        h = _window_hashes(data, (np.cumsum(n) - n)[owner] + bit) ^ mix(group.view(np.uint64))[owner]
        order = np.lexsort((doc[owner], h))
        hs, ds = h[order], doc[owner][order]
        start = np.concatenate([[True], hs[1:] != hs[:-1]])
        least = ds[np.maximum.accumulate(np.where(start, np.arange(len(hs)), 0))]
        again = np.empty(len(hs), bool)
        again[order] = ds > least
        mask = np.bitwise_or.reduceat(np.where(again, np.int64(1) << bit, 0), firsts)
        keep = mask != 0
        return _batch(["doc", "run", "mask"], doc[keep], run[keep], mask[keep])

    for batch in batches:
        singles: list[tuple[int, int, int]] = []
        for group, split, doc, run, first, body in zip(*(batch[c].to_pylist() for c in ("group", "split", "doc", "run", "first", "body")), strict=True):
            if split:
                if first < 0:
                    singles.append((doc, run, 1 << (-1 - first)))
                elif group != split_group:
                    split_group, split_doc = group, doc
                elif doc > split_doc:
                    singles.append((doc, run, 1 << first))
                continue
            if size >= BUFFER and held and group != held[-1][0]:
                yield compared(held)
                held, size = [], 0
            held.append((group, doc, run, body))
            size += len(body)
        if singles:
            yield _batch(["doc", "run", "mask"], *(np.array(x, np.int64) for x in zip(*singles, strict=True)))
    if held:
        yield compared(held)


def covered(data: np.ndarray, keys: np.ndarray, masked: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether each byte of a text lies in a repeated window. keys: the verdicts of its runs; masked, masks: those runs of which some windows repeat."""
    edge = np.zeros(len(data) + 1, np.int64)
    order = np.argsort(masked)
    masked, masks = masked[order], masks[order]
    for start, part in segments(data):
        _, run, first, count = runs(part)
        full = np.isin(run | FULL, keys)
        np.add.at(edge, start + first[full], 1)
        np.add.at(edge, start + (first + count)[full] + LENGTH - 1, -1)
        if len(masked):
            at = np.searchsorted(masked, run).clip(0, len(masked) - 1)
            for j in np.flatnonzero(masked[at] == run):
                lo, hi = np.searchsorted(masked, run[j], "left"), np.searchsorted(masked, run[j], "right")
                bits = int(np.bitwise_or.reduce(masks[lo:hi]))
                own = start + first[j] + np.flatnonzero([(bits >> i) & 1 for i in range(int(count[j]))])
                np.add.at(edge, own, 1)
                np.add.at(edge, own + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone without the bytes of characters that are not wholly in it, for UTF-8 data."""
    if not len(data):
        return gone
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.concatenate([starts, [len(data)]]))
    return np.repeat(np.logical_and.reduceat(gone, starts), size)


def repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs (id, t, keys, masked, masks): each text with the verdicts of its runs."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    known = rows.filter("id IS NOT NULL")
    spread = F.when(F.col("anchor") < 0, F.xxhash64("run", "doc")).otherwise(F.col("anchor"))
    tuples = known.mapInArrow(_tuples, "anchor long, run long, doc long").repartition(parts, spread).sortWithinPartitions("anchor", "run", "doc")
    verdicts = tuples.mapInArrow(_verdicts, "doc long, key long").groupBy("doc").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    verdicts = written(verdicts, "verdicts").withColumnRenamed("doc", "id")
    mine = known.join(verdicts, "id", "left")  # both uses of the texts share one exchange
    doubtful = mine.filter(F.exists("keys", lambda k: k.bitwiseAND(2) == 2))
    bodies = doubtful.mapInArrow(_doubtful, "group long, split boolean, doc long, run long, first int, body binary").repartition(parts, "group").sortWithinPartitions("split", "group", "doc")
    masks = bodies.mapInArrow(_masks, "doc long, run long, mask long").groupBy("doc").agg(F.collect_list(F.struct("run", "mask")).alias("m"))
    masks = masks.select(F.col("doc").alias("id"), F.col("m.run").alias("masked"), F.col("m.mask").alias("masks"))
    none = F.array().cast("array<bigint>")
    both = mine.join(masks, "id", "left").select("id", "t", *[F.coalesce(c, none).alias(c) for c in ("keys", "masked", "masks")])
    return both.union(rows.filter("id IS NULL").select("id", "t", none, none, none))


def _longs(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row: what goes is each byte in a LENGTH-byte string that also starts in a document of smaller id.

    A null text is empty; texts shorter than LENGTH keep everything; a null id takes no part. Rows that share an id count as one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(batch["t"].to_pylist()):
                data = bytes_of(text)
                gone = covered(data, *(_longs(batch[c], i) for c in ("keys", "masked", "masks")))
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if len(gone) else 0
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if out:
                n, removed, spans, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated(docs, id_col, text_col).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, kept) of each row: the digest of its text, and its text without repeats; a character goes only with all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sha = [], []
            for i, text in enumerate(batch["t"].to_pylist()):
                data = bytes_of(text)
                sha.append(hashlib.sha256(data).hexdigest())
                gone = whole_characters(data, covered(data, *(_longs(batch[c], i) for c in ("keys", "masked", "masks"))))
                out.append(data[~gone].tobytes().decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sha, pa.string()), pa.array(out, pa.string())], ["id", "text_sha256", "kept"])

    return repeated(docs, id_col, text_col).mapInArrow(run, "id long, text_sha256 string, kept string").withColumnRenamed("id", id_col)
