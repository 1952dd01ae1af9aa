"""Running values, lookups, nested phases and chains against plain loops, with one group that has nearly all rows."""

import math
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.queries import aggregates
from tidemark.streaming import operators as S


def rows_of(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [(r.choice(["a"] * 8 + ["b", None]), k // 3, k, r.choice([None, r.randrange(-9, 9), r.randrange(-9, 9)])) for k in range(n)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_scan(spark, ranges):
    data = rows_of(300)
    df = spark.createDataFrame(data, "k string, t int, id int, v int").repartition(5)
    v = F.col("v")
    got = {r["id"]: tuple(r)[4:] for r in ordered.scan(df, ["k"], ["t", "id"], ranges, s=("sum", v), lo=("min", v), hi=("max", v), last=("last", v), before=("before", v)).collect()}
    seen: dict = {}
    for k, _, i, x in data:
        past = seen.setdefault(k, [])
        now = past + ([x] if x is not None else [])
        assert got[i] == (sum(now) if now else None, min(now, default=None), max(now, default=None), now[-1] if now else None, past[-1] if past else None)
        seen[k] = now


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k string, t int")
    assert ordered.scan(df, ["k"], ["t"], n=("sum", F.lit(1))).count() == 0


def test_scan_splits_a_hot_group(spark):
    """All rows of one group: they are shuffled by range, and none but summaries meet by group alone."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = ordered.scan(df, ["k"], ["t"], 16, n=("sum", F.lit(1)))
        parts = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 60_000
        assert out.filter("n <> t + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_containing_many_starts_in_one_place(spark):
    starts = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").alias("doc_id"), F.floor(F.col("id") / 2).alias("start"))
    probes = spark.range(50_000).select(F.lit("g").alias("g"), F.col("id").alias("probe"), F.col("id").alias("pos"))
    assert ordered.containing(starts, probes, "g").filter("doc_id <> 2 * pos + 1 OR doc_id IS NULL").count() == 0
    early = spark.createDataFrame([("g", 1, -1), ("h", 2, 5), (None, 3, 1)], "g string, probe long, pos long")
    assert {r["probe"]: r["doc_id"] for r in ordered.containing(starts, early, "g").collect()} == {1: None, 2: None, 3: None}


def test_nested_phases(spark):
    r = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    data = [(r.choice([1] * 9 + [2, None]), f"p{k}", r.choice(["begin", "end", "end"] if k > 200 else ["begin", "begin", "end"]), day + dt.timedelta(milliseconds=7 * k)) for k in range(500)]
    stack, want = [], []
    for i, name, edge, t in data:
        if edge == "begin":
            stack.append((i, name, t))
            continue
        found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == i), None)
        if found is not None:
            _, began, t0 = stack.pop(found)
            want.append((i is not None, i or 0, began, (t - t0) // dt.timedelta(milliseconds=1)))
    got = S.phases(spark.createDataFrame(data, "id long, name string, edge string, ts timestamp_ntz").repartition(3))
    assert sorted((r["id"] is not None, r["id"] or 0, r["name"], r["millis"]) for r in got.collect()) == sorted(want)


def fold(chunks: list[tuple]) -> tuple:
    old = new = None
    for a, b in chunks:
        if old is None:
            old, new = (a, b) if a is not None and b is not None else (None, None)
        else:
            new = b if new is not None and new == a else None
    return old, new


def test_chain_of_chunks(spark):
    data, want = [], {}
    states = ["x", "y", None]
    for k, chunks in enumerate(itertools.product(itertools.product(states, states), repeat=3)):
        data += [(k, j, a, b) for j, (a, b) in enumerate(chunks)]
        want[k] = fold(list(chunks))
    data += [(-1, j, f"s{j}", f"s{j + 1}") for j in range(2000)] + [(-2, j, f"s{j}", f"s{j + 1 + (j == 1500)}") for j in range(2000)]
    want |= {-1: ("s0", "s2000"), -2: ("s0", None)}
    df = spark.createDataFrame(data, "k int, j int, old string, new string").repartition(6)
    assert {r["k"]: (r["old"], r["new"]) for r in ordered.merged_chain(df, ["k"], "j").collect()} == want


def test_rates_at_probes_that_share_a_time(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    samples = spark.createDataFrame([(1, at(t), n) for t, n in [(0, 4), (5, 6), (10, 1), (10, 1), (30, 9)]], "k int, ts timestamp, n long")
    probes = spark.createDataFrame([(k, at(t)) for k, t in [(1, 0), (1, 10), (1, 10), (1, 15), (1, 29), (1, 30), (2, 3)]], "k int, ts timestamp")
    got = sorted((r["k"], (r["ts"] - at(0)).seconds, r["rate"], r["total"]) for r in S.rates_at(samples, probes, ["k"], "n", 10, 12).collect() if r["k"] == 1)
    assert got == [(1, 0, 0.4, 4), (1, 10, 1.2, 12), (1, 10, 1.2, 12), (1, 15, 0.8, 12), (1, 29, 0.0, 12), (1, 30, 0.9, 21)]


def test_nested_fits_ranges_once(spark, monkeypatch):
    """And its plan doesn't run what is below it again for each scan."""
    fitted = []
    fit = type(spark.range(0)).approxQuantile
    monkeypatch.setattr(type(spark.range(0)), "approxQuantile", lambda self, *a: fitted.append(a) or fit(self, *a))
    df = spark.range(2000).select((F.col("id") % 5).alias("k"), F.col("id").alias("t"), (F.col("id") % 20 < 10).alias("opens"))
    done = ordered.nested(df, "k", ["t"], F.col("opens"), F.struct("t"))
    assert len(fitted) == 1 and "Range (" not in done._jdf.queryExecution().executedPlan().toString()
    # Key k opens at t and t + 5 of each twenty, and closes at t + 10 and t + 15, the inner one first.
    got = sorted((r["t"], r["opened"]["t"]) for r in done.collect())
    assert got == [(t, t - 5 if t % 20 < 15 else t - 15) for t in range(2000) if t % 20 >= 10]


def test_ranges_of_odd_places(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), *((float(k // 3),) for k in range(300))], "x double")
    got = sorted(((r["x"], r["__range"]) for r in ordered.ranged(df, "x", 8).collect()), key=lambda p: (math.isnan(p[0]), p[0]))
    assert [n for _, n in got] == sorted(n for _, n in got) and 4 <= len({n for _, n in got}) <= 9
    assert len({(x, n) for x, n in got[:-1]}) == len({x for x, _ in got[:-1]})


def test_phase_rates_shuffles_each_table_once(spark, monkeypatch):
    """Phases of ids with few edges are found where their id's edges meet, and stay there for the join; no ranges are fitted."""
    fitted = []
    fit = type(spark.range(0)).approxQuantile
    monkeypatch.setattr(type(spark.range(0)), "approxQuantile", lambda self, *a: fitted.append(a) or fit(self, *a))
    plan = aggregates.phase_rates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not fitted and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("whole", [0, 3, 100, 1000])
def test_phases_of_keys_with_few_and_many_edges(spark, monkeypatch, whole):
    """All in ranges; all but key 3 (at whole 3); key 1 and null alone; all whole."""
    monkeypatch.setattr(ordered, "WHOLE", whole)
    r = random.Random(9)
    day = dt.datetime(2024, 1, 1)
    data = [(r.choice([1] * 6 + [None] * 3 + [2]), f"p{k}", r.choice(["begin", "begin", "end"] if k < 200 else ["begin", "end", "end"]), day + dt.timedelta(milliseconds=7 * k)) for k in range(600)]
    data += [(3, "a", "end", day), (3, "b", "begin", day + dt.timedelta(seconds=1)), (3, "b", "end", day + dt.timedelta(seconds=3))]
    open_, want = {}, []
    for i, name, edge, t in data:
        if edge == "begin":
            open_.setdefault(i, []).append((name, t))
        elif open_.get(i):
            began, t0 = open_[i].pop()
            want.append((i is not None, i or 0, began, t0, (t - t0) // dt.timedelta(milliseconds=1)))
    edges = spark.createDataFrame(data, "id long, name string, edge string, ts timestamp_ntz").repartition(3)
    many = ordered.crowded(edges, "id", whole)
    counts = {i: sum(d[0] == i for d in data) for i in (1, 2, 3, None)}
    assert {m["_key"] for m in many.collect()} == {i for i, n in counts.items() if n > whole} if many is not None else whole >= max(counts.values())
    got = S.phases(edges)
    assert sorted((r["id"] is not None, r["id"] or 0, r["name"], r["begin"], r["millis"]) for r in got.collect()) == sorted(want)
