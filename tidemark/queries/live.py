"""Queries that run event-driven operators on streams: events are spooled by time and replayed, with a stop and a restart in the middle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.queries import streams as batch
from tidemark.registry import ORACLE, query
from tidemark.sources import events
from tidemark.sources.shared import shared_dir
from tidemark.sources.tables import table, view
from tidemark.streaming import operators as S
from tidemark.streaming import state

#: Slots of time that events are spooled in, slots that a micro-batch takes, and after how many the query is stopped and begun again.
SLOTS, STEP, STOP = 4, 2, 2


def _micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _replayed(spark, rows: DataFrame, build, batches=None) -> DataFrame | None:
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    empty = events.spool(rows, f"{folder}/slots", SLOTS)
    return state.replayed(spark, f"{folder}/slots", empty, lambda s: build(s.withWatermark("ts", "0 seconds")), folder, (STOP,), STEP, batches)


@query(ORACLE["own_batches"])
def own_batches_live(spark, d):
    """STM-06 with its map of writes as state."""
    micros = F.col("micros")
    whole, notes = batch.own_parts(spark, d)
    own = whole.select(F.col("user_id").alias("k"), "batch", "path", _micros().alias("t")).groupBy("k", "batch").agg(F.max("t").alias("micros"), F.collect_set("path").alias("paths"))
    rows = notes.select(F.col("user_id").alias("k"), _micros().alias("micros"), F.lit(-1).cast("long").alias("batch"), F.array("path").alias("paths")).unionByName(own)
    got = _replayed(spark, rows.withColumn("ts", F.timestamp_micros(micros)), lambda s: state.own_batches(s, 3600))
    return got.select(F.col("k").alias("user_id"), "batch", "own")


@query(ORACLE["watchdog_gaps"].replace("WHERE gap > budget * 1000000", "WHERE gap IS NULL OR gap > budget * 1000000"))
def watchdog_live(spark, d):
    """STM-09 with timers: the last event of each user is found dead as well."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("k"), "event_id", _micros().alias("micros"), batch.ping().alias("ping"), "ts")
    return _replayed(spark, rows, state.watchdog).select(F.col("k").alias("user_id"), "event_id", "budget")


@query()
def hook_retries_live(spark, d):
    """STM-13 with one slot and one timer a user; not in SQL, as hook_retries, with which the tests compare it."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), (F.col("event_id") % 4).alias("fails"), "ts")
    return _replayed(spark, rows, lambda s: state.hook_runs(s, 7200, 2)).select(F.col("k").alias("user_id"), "start", F.col("n").alias("triggers"), "attempts", "ok")


@query(ORACLE["state_advance_seeded"])
def state_advance_live(spark, d):
    """STM-08 with its states kept over the restart, the first of them from seeds."""
    e, seeds = batch.seeded(spark, d)
    rows = e.select(F.col("user_id").alias("k"), "event_id", _micros().alias("micros"), "state", "ok", "ts")
    return _replayed(spark, rows, lambda s: state.advances(s, seeds.withColumnRenamed("user_id", "k"))).select(F.col("k").alias("user_id"), "event_id")


@query(ORACLE["coalesce_triggers"])
def coalesce_triggers_live(spark, d):
    """STM-01, 02 and 04 on the source of events: runs of triggers by session windows."""
    got = _replayed(spark, view(spark, d, "triggers"), lambda s: S.sessions(s, "30 minutes", ["user_id"])).filter("user_id IS NOT NULL")
    micros = lambda c: F.unix_micros(c).alias(c)
    return got.select("user_id", micros("start"), micros("end"), "n", "kind", S.scope(F.col("kind")).alias("scope"))


@query("""
    WITH b AS (SELECT event_id // 4 AS batch, epoch_us(max(ts)) AS ended, string_agg(concat('a/', CASE WHEN event_id % 6 = 0 THEN 'cur' ELSE 'new' END, '/', event_id), ' ' ORDER BY concat('a/', CASE WHEN event_id % 6 = 0 THEN 'cur' ELSE 'new' END, '/', event_id)) FILTER (event_id % 6 IN (0, 1)) AS paths,
        bool_or(event_id % 6 = 0 OR event_id % 6 = 1 AND event_id % 5 = 0) AS live FROM events GROUP BY 1)
    SELECT batch, ended, paths FROM b WHERE live
""")
def batch_changes_live(spark, d):
    """STM-05 and STM-14: each micro-batch of whole batches is classified and those with changes are handed on, if there are any; the one handed on last stays what it is when a batch is done twice."""
    k = F.col("event_id")
    sub = F.when(k % 6 == 0, "a/cur/").when(k % 6 == 1, "a/new/").otherwise("b/tmp/")
    e = table(spark, d, "events").select(F.floor(k / 4).alias("batch"), F.concat(sub, k.cast("string")).alias("path"), (k % 5 != 0).alias("exists"), "ts")
    whole = e.groupBy("batch").agg(F.max("ts").alias("ts"), F.collect_list(F.struct("path", "exists")).alias("events"))
    folder = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"

    def handle(changes: DataFrame, number: int) -> None:
        one = changes.select("batch", "ts", F.explode("events").alias("e")).select("batch", "ts", F.col("e.path").alias("path"), F.col("e.exists").alias("exists"), F.lit(None).cast("boolean").alias("fires"))
        times = changes.select("batch", F.unix_micros("ts").alias("ended"))
        S.classified(one).join(times, "batch").select("batch", "ended", F.array_join("paths", " ").alias("paths")).write.mode("overwrite").parquet(f"{folder}/number={number}")

    _replayed(spark, whole, lambda s: s.filter("batch IS NOT NULL"), S.on_changes(handle))
    return spark.read.schema("batch long, ended long, paths string").parquet(folder).select("batch", "ended", "paths")
