"""Weighted rendezvous hashing of record keys over shards, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

#: Parts of each shard that are numbered on their own; their counts (shards x PARTS rows) are all that is broadcast.
PARTS = 1024


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide: the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose -ln(draw) / weight is least; each shard's share is in proportion to its weight.

    A shard's draws depend on no other shard, so that a shard added takes rows only into itself.
    A null key counts as the empty string. Shards of weight 0 get nothing.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct((-F.ln(draw(key, k)) / F.lit(float(w))).alias("bid"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*bids))["shard"]


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 24, grown_weight: float = 1.0) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot, grown_shard (with one more shard of grown_weight).

    size: UTF-8 bytes of the text (null: none) and 8. slot numbers the rows of a shard from 0 without gaps:
    the shard's parts (by a hash of the key) are numbered on their own and follow one another by their counts.
    Repeated rows get slots of their own. Other columns of docs don't matter.
    """
    key = F.col(id_col)
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    text = text_of(text_col)
    where = docs.select(rendezvous(key, weights).alias("shard"), part.alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = where.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rows = docs.select(
        key.alias(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, grown_weight]).alias("grown_shard"), part.alias("part"),
    )
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy(id_col, "text_crc32"))
    return rows.withColumn("nth", nth).join(F.broadcast(starts), ["shard", "part"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"
    )
