"""The source of slots, and operators with state on streams: restarts, commits, late timers and forgotten writes."""

import datetime as dt
import time
import types
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.sources import events
from tidemark.sources.shared import shared_dir, shared_uri
from tidemark.streaming import operators as S
from tidemark.streaming import state

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_slots_are_read_once_over_restarts(spark, folder):
    rows = spark.range(1000).select(F.col("id"), (F.lit(at(0)) + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    empty = events.spool(rows, f"{folder}/slots", 5)
    got = state.replayed(spark, f"{folder}/slots", empty, lambda s: s.withColumn("day", F.to_date("ts")), folder, (1, 3))
    assert sorted(r["id"] for r in got.filter("id IS NOT NULL").collect()) == list(range(1000))
    assert got.count() == 1001  # and the tick
    assert {r["day"].year for r in got.filter("id IS NULL").collect()} == {2034}


def test_slots_go_when_committed(spark, folder):
    empty = events.spool(spark.range(100).select("id", (F.lit(at(0)) + F.make_dt_interval(secs=F.col("id"))).alias("ts")), f"{folder}/slots", 4, tick=False)
    reader = events.SlotReader({"path": shared_uri(spark, f"{folder}/slots"), "purge": "true", "step": "2"}, empty.schema)
    assert (reader.initialOffset(), reader.latestOffset(), reader.latestOffset(), reader.latestOffset()) == ({"slot": 0}, {"slot": 2}, {"slot": 4}, {"slot": 4})
    names = lambda a, b: [p.file for p in reader.partitions({"slot": a}, {"slot": b})]
    first, rest = names(0, 1), names(1, 4)
    assert len(first) == 1 and len(rest) == 3 and sum(b.num_rows for p in reader.partitions({"slot": 0}, {"slot": 4}) for b in reader.read(p)) == 100
    reader.commit({"slot": 1})
    assert names(0, 4) == rest  # what is left keeps its offsets
    again = events.SlotReader({"path": shared_uri(spark, f"{folder}/slots")}, empty.schema)
    again.partitions({"slot": 1}, {"slot": 3})  # as a query from its checkpoint does
    assert again.latestOffset() == {"slot": 4}


def test_slots_of_nothing(spark, folder):
    empty = events.spool(spark.createDataFrame([], "id long, ts timestamp"), f"{folder}/slots", 3)
    assert state.replayed(spark, f"{folder}/slots", empty, lambda s: s, folder).count() == 0


def test_hook_slot_equals_its_batch_form(spark):
    rows = lambda name: sorted(tuple(r[c] for c in ("user_id", "start", "triggers", "attempts", "ok")) for r in registry.QUERIES[name](spark, DATA).collect())
    assert rows("hook_retries_live") == rows("hook_retries")


def test_dead_key_fires_without_an_event_of_its_own(spark, folder):
    """Key 1 pings once and is silent; key 2 goes on, and its events move the watermark past key 1's time in the second run already."""
    rows = [(1, 10, 0, 60)] + [(2, 20 + k, k * 50, 60) for k in range(20)]
    df = spark.createDataFrame([(k, e, t * 1_000_000, p, at(t)) for k, e, t, p in rows], "k long, event_id long, micros long, ping long, ts timestamp")
    empty = events.spool(df.withColumn("micros", F.unix_micros("ts")), f"{folder}/slots", 4, tick=False)
    got = state.replayed(spark, f"{folder}/slots", empty, lambda s: state.watchdog(s.withWatermark("ts", "0 seconds")), folder, (2,))
    assert [tuple(r) for r in got.collect()] == [(1, 10, 65)]


def test_live_writes_are_forgotten(spark, folder):
    """By Spark's own TTL: by their times the second write would still count."""
    path, out = f"{folder}/in", []
    frame = lambda *rows: spark.createDataFrame([(1, micros, batch, ["a"]) for micros, batch in rows], "k long, micros long, batch long, paths array<string>").coalesce(1)
    frame((10, -1), (11, 1)).write.parquet(path)
    stream = spark.readStream.schema(frame().schema).parquet(path)
    with state._rocks(spark):
        q = state.own_batches(stream, 4, live=True).writeStream.foreachBatch(S.on_changes(lambda b, _: out.extend(map(tuple, b.collect())))).option("checkpointLocation", f"{folder}/cp").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while len(out) < 1 and time.time() < until:
            time.sleep(0.2)
        frame((12, -1)).write.mode("append").parquet(path)
        rows = lambda: sum(p["numInputRows"] for p in q.recentProgress)
        while rows() < 3 and time.time() < until:
            time.sleep(0.2)
        time.sleep(5)
        frame((13, 2)).write.mode("append").parquet(path)
        while len(out) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert out == [(1, 1, True), (1, 2, False)]


class Map(dict):
    """A map of state that counts how often it is asked."""

    asked = 0

    def __getattribute__(self, name):
        calls = {"getValue": lambda k: self.get(k), "updateValue": lambda k, v: self.__setitem__(k, v), "removeKey": lambda k: self.pop(k, None), "iterator": lambda: iter(list(self.items()))}
        if name not in calls:
            return super().__getattribute__(name)
        Map.asked += 1
        return calls[name]


def test_writes_that_are_used_up_at_once_never_reach_the_state(monkeypatch):
    timers = []
    kept = Map()
    op = state.OwnWrites(3600, live=False)
    op.init(types.SimpleNamespace(getMapState=lambda *_: kept, registerTimer=timers.append))
    row = lambda t, batch, *paths: Row(micros=t * 1_000_000, batch=batch, paths=list(paths))
    monkeypatch.setattr(Map, "asked", 0)
    rows = [r for k in range(500) for r in (row(k * 4000, -1, f"a{k}"), row(k * 4000 + 60, k, f"a{k}"))]
    assert all(r["own"] for r in op.handleInputRows((1,), iter([*rows, row(2_000_000, -1, "b")]), None))
    assert Map.asked <= 5 and len(timers) == 1 and dict(kept) == {("b",): (2_000_000_000_000,)}
    # A later micro-batch finds what is left: once within the time, then no more.
    later = [row(2_000_100, 1000, "b"), row(2_000_101, 1001, "b"), row(2_000_102, -1, "c"), row(2_003_702, 1002, "c")]
    assert [r["own"] for r in op.handleInputRows((1,), iter(later), None)] == [True, False, False]
    assert dict(kept) == {("c",): (2_000_102_000_000,)} and timers[1] * 1000 >= 2_003_702_000_000


def test_slots_are_read_by_several_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(events, "GROUP", 100)
    empty = events.spool(spark.range(1000).select("id", (F.lit(at(0)) + F.make_dt_interval(secs=F.col("id"))).alias("ts")), f"{folder}/slots", 1, tick=False)
    reader = events.SlotReader({"path": shared_uri(spark, f"{folder}/slots")}, empty.schema)
    parts = reader.partitions({"slot": 0}, {"slot": 1})
    assert len(parts) == 10 and sum(b.num_rows for p in parts for b in reader.read(p)) == 1000


def test_seeds_count_at_the_first_start_only(spark, folder):
    e = [(1, 1, 0, 3, True), (1, 2, 1, 4, True), (1, 3, 2, 3, True), (2, 4, 0, None, False), (2, 5, 3, 3, True), (2, 6, 4, 3, True), (3, 7, 5, None, True)]
    df = spark.createDataFrame([(k, i, t, s, ok, at(t)) for k, i, t, s, ok in e], "k long, event_id long, micros long, state long, ok boolean, ts timestamp")
    empty = events.spool(df, f"{folder}/slots", 3)
    seeds = spark.createDataFrame([(1, 3)], "k long, state long")
    got = state.replayed(spark, f"{folder}/slots", empty, lambda s: state.advances(s.withWatermark("ts", "0 seconds"), seeds), folder, (1, 2))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (1, 3), (2, 4), (2, 5), (3, 7)]
