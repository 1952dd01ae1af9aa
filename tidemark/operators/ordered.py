"""Running values over rows in order, without any group in one task.

The order is cut into ranges. Each range of a group is summed up by itself; the few summaries of a group are combined in order; then each range runs with what
was carried into it. What is written on top of this, lookups of the row before, nested phases, chains and windows of time, comes down to such scans.
"""

from __future__ import annotations

import functools
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Ranges of the order; a group has at most so many summaries.
RANGES = 256
#: Rows of one key that nested may put in order in one task.
WHOLE = 100_000
#: Hashes by which rows are counted, to find the keys that may have more.
BUCKETS = 1 << 16


def ranged(rows: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """rows with __range, the range that a row's place in a numeric order is in; ranges have about as many rows each, and rows of one place are together."""
    cuts = sorted({c for c in rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if math.isfinite(c)}) if ranges > 1 else []
    if not cuts:
        return rows.withColumn("__range", F.lit(0))
    found = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=order, outputCol="__range", handleInvalid="keep").transform(rows)
    return found.withColumn("__range", F.coalesce(F.col("__range").cast("int"), F.lit(0)))


def scan(rows: DataFrame, keys: list[str], order: list[str], ranges: int = RANGES, **running: tuple[str, Column]) -> DataFrame:
    """rows with a column for each of running, (kind, value): what kind makes of value over the rows of its keys up to and with each, in order.

    Kinds are sum, min, max and last, which pass over nulls, and before: the last one, of the rows before alone. order is a numeric column, without nulls, and others that break
    its ties. Null keys are one group. Rows are shuffled once; of their summaries there is one for each key and range, and only those after a key's first are joined. Rows that have been
    ranged by this order already keep their ranges.
    """
    here = Window.partitionBy("__key", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = (rows if "__range" in rows.columns else ranged(rows, order[0], ranges)).withColumns({"__key": F.struct(*keys), **{f"__v_{n}": v for n, (_, v) in running.items()}})
    plain = {"sum": F.sum, "min": F.min, "max": F.max}
    place = F.struct(*order)
    summary, carried, inner, columns = [], {}, {}, {}
    for name, (kind, _) in running.items():
        v = F.col(f"__v_{name}")
        last = kind in ("last", "before")
        summary.append((F.max(F.when(v.isNotNull(), F.struct(place.alias("o"), v.alias("v")))) if last else plain[kind](v)).alias(f"__s_{name}"))
        earlier = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        carried[f"__c_{name}"] = F.last(f"__s_{name}.v", ignorenulls=True).over(earlier) if last else plain[kind](f"__s_{name}").over(earlier)
        inner[f"__i_{name}"] = F.last(v, ignorenulls=True).over(here if kind == "last" else here.rowsBetween(Window.unboundedPreceding, -1)) if last else plain[kind](v).over(here)
        i, c = F.col(f"__i_{name}"), F.col(f"__c_{name}")
        columns[name] = {"sum": F.coalesce(i + c, i, c), "min": F.least(i, c), "max": F.greatest(i, c)}.get(kind, F.coalesce(i, c))
    sums = own.groupBy("__key", "__range").agg(*summary).withColumns(carried).select("__key", "__range", *carried)
    both = own.withColumns(inner).join(sums.filter(functools.reduce(Column.__or__, [F.col(c).isNotNull() for c in carried])), ["__key", "__range"], "left")
    return both.select(*[c for c in rows.columns if c not in columns], *[e.alias(n) for n, e in columns.items()])


def containing(rows: DataFrame, probes: DataFrame, group: str) -> DataFrame:
    """probes (group, probe, pos) with the doc_id of rows (group, doc_id, start) that starts last at or before pos, of several that start there the largest; null if none does.

    Starts and probes are merged into one order, along which the last start is carried: each row is looked at once.
    """
    starts = rows.select(group, F.col("start").alias("_pos"), F.lit(0).alias("_kind"), F.col("doc_id").alias("_doc"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    asked = probes.select(group, F.col("pos").alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("_doc"), "probe")
    found = scan(starts.unionByName(asked), [group], ["_pos", "_kind", "_doc"], doc_id=("last", F.col("_doc")))
    return found.filter("_kind = 1").select(group, "probe", F.col("_pos").alias("pos"), "doc_id")


def crowded(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """(_key) of the keys with more than most rows; None if there are none. Rows are counted by a hash of their key, and by the key itself only where a hash has more than most."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    full = [r[0] for r in rows.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > most).collect()]
    if not full:
        return None
    keys = written(rows.filter(bucket.isin(full)).groupBy(F.col(key).alias("_key")).count().filter(F.col("count") > most).select("_key"), "keys")
    return None if keys.isEmpty() else keys


def _level() -> Column:
    """How deep an edge is: what opens counts itself, what closes counts what it closes."""
    return F.when(F.col("_step") > 0, F.col("_sum") - F.col("_floor")).otherwise(F.col("_sum") + 1 - F.col("_floor"))


def nested(edges: DataFrame, key: str, order: list[str], opens: Column, value: Column, whole: int = 0) -> DataFrame:
    """edges that close something, with opened: the value of what they close, which is what their key opened last and hasn't closed yet. Closings of nothing are left out.

    A key's depth goes up and down by one, and never below zero: where its plain sum falls to a new least value, nothing was open, and
    the sum counts from there on. What opens at a depth is closed by the next closing at that depth, so that the last one before it there is its own.
    Keys of at most whole edges are put in order by one task each, all in one shuffle; the edges of other keys are cut into ranges.
    """
    if not whole:
        return _nested_in_ranges(edges, key, order, opens, value)
    many = crowded(edges, key, whole)
    if many is None:
        return _nested_by_key(edges, key, order, opens, value)
    of = lambda how: edges.join(F.broadcast(many), F.col(key).eqNullSafe(F.col("_key")), how)
    return _nested_by_key(of("left_anti"), key, order, opens, value).union(_nested_in_ranges(of("left_semi"), key, order, opens, value))


def _nested_by_key(edges: DataFrame, key: str, order: list[str], opens: Column, value: Column) -> DataFrame:
    """All windows hold their key, so that what is shuffled by it for the first serves the others too."""
    here = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = edges.withColumn("_step", F.when(opens, 1).otherwise(-1)).withColumn("_sum", F.sum("_step").over(here)).withColumn("_floor", F.min(F.col("_sum") - F.col("_step")).over(here))
    rows = rows.withColumn("_level", _level()).filter("_level > 0")
    before = Window.partitionBy(key, "_floor", "_level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("opened", F.last(F.when(F.col("_step") > 0, value), ignorenulls=True).over(before))
    return rows.filter("_step < 0").drop("_step", "_sum", "_floor", "_level")


def _nested_in_ranges(edges: DataFrame, key: str, order: list[str], opens: Column, value: Column) -> DataFrame:
    rows = ranged(edges.withColumns({"_step": F.when(opens, 1).otherwise(-1), "_value": value}), order[0])
    here = Window.partitionBy(key, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Sum and least value of each range by itself; they are written once, as what comes next reads them several times.
    rows = written(rows.withColumn("_sum", F.sum("_step").over(here)).withColumn("_floor", F.min(F.col("_sum") - F.col("_step")).over(here)), "edges")
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "__range").agg(F.sum("_step").alias("_s"), F.min("_floor").alias("_m")).withColumn("_base", F.sum("_s").over(earlier))
    sums = sums.withColumn("_least", F.min(F.coalesce("_base", F.lit(0)) + F.col("_m")).over(earlier)).filter("_base IS NOT NULL")
    sums = sums.select(F.col(key).alias("_key"), F.col("__range").alias("_range"), "_base", "_least")
    rows = rows.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("__range") == F.col("_range")), "left").drop("_key", "_range")
    base = F.coalesce("_base", F.lit(0))
    rows = rows.withColumns({"_sum": F.col("_sum") + base, "_floor": F.least(F.col("_floor") + base, "_least")}).drop("_base", "_least")
    rows = written(rows.withColumn("_level", _level()).filter("_level > 0"), "levels")
    rows = scan(rows, [key, "_floor", "_level"], order, opened=("before", F.when(F.col("_step") > 0, F.col("_value"))))
    return rows.filter("_step < 0").drop("_step", "_value", "_sum", "_floor", "_level", "__range")


def merged_chain(chunks: DataFrame, keys: list[str], order: str, old: str = "old", new: str = "new") -> DataFrame:
    """(keys, old, new) of chunks (keys, order, old, new), each of which goes from state to state: where the chain begins, and where it leads if it holds.

    Chunks that lack a state are passed over before the first whole one. From there on each chunk must be whole and begin where the one before ended; else new is null. Without
    a whole chunk both are. The pieces that ranges make are folded in order; it doesn't matter how chunks are split among them.
    """
    whole = F.col(old).isNotNull() & F.col(new).isNotNull()
    rows = scan(chunks, keys, [order], _before=("before", F.when(whole, F.struct(F.col(new).alias("n")))))
    breaks = F.when(F.col("_before").isNotNull(), ~(whole & F.col(old).eqNullSafe(F.col("_before.n"))))
    first, last = F.min(F.when(whole, F.struct(F.col(order).alias("o"), F.col(old).alias("s")))), F.max(F.when(whole, F.struct(F.col(order).alias("o"), F.col(new).alias("s"))))
    g = rows.groupBy(*keys).agg(first.alias("_f"), last.alias("_l"), F.coalesce(F.bool_or(breaks), F.lit(False)).alias("_broken"))
    return g.select(*keys, F.col("_f.s").alias(old), F.when(~F.col("_broken"), F.col("_l.s")).alias(new))
