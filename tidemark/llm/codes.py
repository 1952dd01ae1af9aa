"""Vectors as codes of their parts, found by tables over the few different integers that each dimension holds.

Vectors become rows of integers, kept in blocks: for each dimension a block has a sorted dictionary of its different values, and
for each vector that dictionary's codes. Against a codebook, the squared differences of every value to all entries are tabulated once for a
block and dimension; a part's distances are then rows of these tables, gathered by code and added. Blocks are written once and
read in each round; a round gives counts and sums by part and entry, so that only codebooks, ENTRIES times a vector long, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_IDS, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and of those whose distances are held at a time. A dictionary has no more values than its block has vectors, so that 16 bits hold a code.
BLOCK, HELD = 1 << 13, 1 << 9
#: Integers must be smaller than this, so that squared distances of 1,000 dimensions fit in 64 bits.
BOUND = 1 << 25

#: With the label's type put in.
BLOCKS = "vec_id array<long>, label array<{}>, values binary, sizes array<int>, codes binary"
CODED = "vec_id long, label {}, code string, error long"


def finite(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, x) of the vectors that have finite components only."""
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.filter(F.col("x").isNotNull()).filter(whole).select("vec_id", "label", "x")


def _scaled(column: pa.ListArray, width: int) -> np.ndarray:
    """The integers of a batch of vectors, a row each."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors must have {width} components, as the first one has, but one has {lengths[lengths != width][0]}")
    v = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    if v.size and np.abs(v).max() >= BOUND:
        raise ValueError(f"components must be smaller than {BOUND // SCALE} in absolute value")
    return v.astype(np.int64).reshape(len(lengths), width)


def _list(arrays: list[pa.Array]) -> pa.ListArray:
    """One row with all the values of arrays."""
    values = pa.concat_arrays(arrays)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """BLOCKS rows of (vec_id, label, x): up to BLOCK vectors each, with a dictionary of every dimension's values one after another (sizes: how many), and codes by dimension."""

    kind = vectors.schema["label"].dataType.simpleString()

    def block(ids: list, labels: list, v: np.ndarray) -> pa.RecordBatch:
        words = [np.unique(v[:, k], return_inverse=True) for k in range(width)]
        values = b"".join(w.astype("<i4").tobytes() for w, _ in words)
        codes = b"".join(c.astype("<u2").tobytes() for _, c in words)
        columns = [_list(ids), _list(labels), pa.array([values], pa.binary()), pa.array([[len(w) for w, _ in words]], pa.list_(pa.int32())), pa.array([codes], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "values", "sizes", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, n = [], [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield block(ids, labels, np.concatenate(rows))
                    ids, labels, rows, n = [], [], [], 0
                ids.append(part["vec_id"])
                labels.append(part["label"])
                rows.append(_scaled(part["x"], width))
                n += part.num_rows
        if n:
            yield block(ids, labels, np.concatenate(rows))

    return vectors.mapInArrow(run, BLOCKS.format(kind))


def _nearest(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a block, by vector and part: the nearest entry of books (entry, dimension), its squared distance; and each dimension's dictionary.

    Distances are summed in 32 bits where none can be larger.
    """
    width, n = codes.shape
    starts = np.cumsum(sizes) - sizes
    words = [values[a : a + s].astype(np.int64) for a, s in zip(starts, sizes, strict=True)]
    step = width // PARTS
    entry, least = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), np.int64)
    for p in range(PARTS) if step else ():
        tables = [np.square(words[k][:, None] - books[None, :, k]) for k in range(p * step, (p + 1) * step)]
        if sum(int(t.max()) for t in tables) < 2**31:
            tables = [t.astype(np.int32) for t in tables]
        for at in range(0, n, HELD):
            part = codes[p * step : (p + 1) * step, at : at + HELD]
            total = tables[0][part[0]]
            for t, c in zip(tables[1:], part[1:], strict=True):
                total += t[c]
            entry[at : at + HELD, p] = best = total.argmin(axis=1)
            least[at : at + HELD, p] = np.take_along_axis(total, best[:, None], axis=1)[:, 0]
    return entry, least, words


def _read(b: pa.RecordBatch, width: int) -> Iterator[tuple]:
    for ids, labels, values, sizes, codes in zip(b["vec_id"], b["label"], b["values"], b["sizes"], b["codes"], strict=True):
        codes = np.frombuffer(codes.as_buffer(), "<u2").reshape(width, -1) if width else np.zeros((0, len(ids)), np.uint16)
        yield ids.values, labels.values, np.frombuffer(values.as_buffer(), "<i4"), sizes.values.to_numpy(), codes


def summed(table: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums) of a table of blocks: how many parts are nearest to each entry, and their componentwise sums. Each task gives a row for each part and entry that it has."""
    width = books.shape[1]
    step = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, step), np.int64)
        for b in batches:
            for _, _, values, sizes, codes in _read(b, width):
                entry, _, words = _nearest(values, sizes, codes, books)
                for p in range(PARTS):
                    n[p] += np.bincount(entry[:, p], minlength=ENTRIES)
                    for k in range(step):
                        np.add.at(sums[p, :, k], entry[:, p], words[p * step + k][codes[p * step + k]])
        at = np.argwhere(n)
        rows = [(int(p), int(e), int(n[p, e]), sums[p, e].tolist()) for p, e in at]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "sums"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    rows = table.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    by_place = [F.sum(F.element_at("sums", k + 1)) for k in range(step)]
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*by_place).cast("array<long>").alias("sums"))


def coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """CODED rows of a table of blocks: two hex digits for each part, and the squared distances of the parts summed."""
    width = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, values, sizes, codes in _read(b, width):
                entry, least, _ = _nearest(values, sizes, codes, books)
                hexed = entry.astype(np.uint8).tobytes().hex()
                code = [hexed[k : k + 2 * PARTS] for k in range(0, len(hexed), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(least.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, CODED.format(table.schema["label"].dataType.elementType.simpleString()))


def listed(books: np.ndarray) -> str:
    """The integers of books (entry, dimension) by part, entry and place, with commas between."""
    entries, width = books.shape
    by_part = books.reshape(entries, PARTS, width // PARTS).transpose(1, 0, 2)
    return ",".join(map(str, by_part.ravel().tolist()))


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of all vectors that are neither null nor hold a null, NaN or infinite component.

    Codebooks begin as the parts of the ENTRIES smallest ids, one without an id after all others, repeated ids by their components; of fewer vectors, as
    many. Nearest ties go to the lower entry. Null labels count as one. Repeated rows are coded each. Vectors must all have the length of that of the smallest id, a
    multiple of PARTS, and components under BOUND / SCALE; else that is an error. Without vectors there are no rows.
    """
    spark = vectors.sparkSession
    kept = finite(vectors, id_col, vector_col, label_col)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    width = len(first[0]["x"]) if first else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    if any(len(r["x"]) != width for r in first):
        raise ValueError(f"vectors must all have {width} components, as the first one has")
    books = np.floor(np.array([r["x"] for r in first], np.float64).reshape(len(first), width) * SCALE).astype(np.int64)
    table = written(blocks(kept, width), "blocks")
    for _ in range(rounds if width else 0):
        books = books.copy()
        for r in summed(table, books).collect():
            step = width // PARTS
            books[r["entry"], r["part"] * step : (r["part"] + 1) * step] = np.array(r["sums"], np.int64) // r["n"]
    rows = written(coded(table, books), "codes")
    by_label = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__tidemark_label"), "labels")
    by_label = F.broadcast(by_label) if by_label.count() <= BROADCAST_IDS else by_label
    both = rows.join(by_label, rows["label"].eqNullSafe(by_label["__tidemark_label"]))
    digest = hashlib.sha256(listed(books).encode()).hexdigest()
    return both.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
