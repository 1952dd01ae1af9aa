"""Operators that keep state from event to event on a stream: Spark's transformWithState with value and map states, timers and initial states.

Each takes a stream with a watermark on its time and gives rows in append mode; the batch forms in operators.py give the same rows over a table. A key's rows of one
micro-batch are put in order of time in its task; state is in the state store, checkpointed with the query. Rows must come in order of time from batch to
batch, or within the watermark's delay and be taken as they come. Timers fire by the watermark, so that what is due without a further event of its key comes with anybody's next one.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.events import stream
from tidemark.streaming.operators import MOST_RETRIES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(micros: int) -> int:
    """The first whole millisecond at or after a time."""
    return -(-micros // 1000)


def _ordered(rows: Iterator[Row], *names: str) -> list[Row]:
    """A key's rows in order. Ticks, which have nothing but their time, only move the watermark; a filter before the operator would keep them from it."""
    return sorted((r for r in rows if r[names[0]] is not None), key=lambda r: tuple(r[n] for n in names))


class OwnWrites(StatefulProcessor):
    """A map from paths to when they were written. A batch whose paths were all written less than ttl seconds before uses its entries up.

    A key's entries are read once a micro-batch, and what has changed at its end is put back: a write that is used up in its own micro-batch never gets there.
    By event time entries go by a timer, one for what a micro-batch leaves; live, the map itself forgets them by Spark's TTL.
    """

    def __init__(self, ttl: int, live: bool):
        self.ttl, self.live = ttl * 1_000_000, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getMapState("written", "path string", "micros long", self.ttl // 1000 if self.live else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = _ordered(rows, "micros", "batch")
        if not rows:
            return
        before = {path[0]: value[0] for path, value in self.written.iterator()}
        now, noted = dict(before), set()
        for r in rows:
            t, batch, paths = r["micros"], r["batch"], r["paths"]
            if batch < 0:
                now.update((p, t) for p in paths)
                noted.update(paths)
                continue
            own = all(p in now and t - now[p] < self.ttl for p in paths)
            if own:
                for p in paths:
                    now.pop(p, None)
            yield Row(k=key[0], batch=batch, own=own)
        for p in before.keys() - now.keys():
            self.written.removeKey((p,))
        left = {p: t for p, t in now.items() if p in noted}
        for p, t in left.items():
            self.written.updateValue((p,), (t,))
        if left and not self.live:
            self.handle.registerTimer((max(left.values()) // self.ttl + 2) * self.ttl // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for path in [path for path, value in self.written.iterator() if now - value[0] >= self.ttl]:
            self.written.removeKey(path)
        return iter(())

    def close(self) -> None:
        pass


def own_batches(rows: DataFrame, ttl: int, live: bool = False) -> DataFrame:
    """(k, batch, own) of a stream of writes and batches (k, micros, batch, paths, ts): a write has the batch -1, and paths each once. As operators.own_batches."""
    return rows.groupBy("k").transformWithState(OwnWrites(ttl, live), "k long, batch long, own boolean", "Append", "ProcessingTime" if live else "EventTime")


class Watchdog(StatefulProcessor):
    """The last event of a key with the time that the next one has, and a timer at its end that each event moves."""

    def __init__(self, first_budget: int, slack: int):
        self.first, self.slack = first_budget, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, micros long, budget long, due long, dead boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = _ordered(rows, "micros")
        if not rows:
            return
        last = self.last.get()
        before = last[3] if last else None
        for r in rows:
            if last and not last[4] and r["micros"] - last[1] > last[2] * 1_000_000:
                yield Row(k=key[0], event_id=last[0], budget=last[2])
            ping = r["ping"]
            known = last[2] if last and last[2] != self.first else None
            budget = ping + self.slack if ping is not None and ping > 0 else known if known is not None else self.first
            last = (r["event_id"], r["micros"], budget, _millis(r["micros"] + budget * 1_000_000) + 1, False)
        self.last.update(last)
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(last[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()
        if not last[4] and last[3] == expiredTimerInfo.getExpiryTimeInMs():
            self.last.update((*last[:4], True))
            yield Row(k=key[0], event_id=last[0], budget=last[2])

    def close(self) -> None:
        pass


def watchdog(rows: DataFrame, first_budget: int = 300, slack: int = 5) -> DataFrame:
    """(k, event_id, budget) of a stream of events (k, event_id, micros, ping, ts) that no event of their key follows in time, the last of each key as well once the watermark is past its time."""
    return rows.groupBy("k").transformWithState(Watchdog(first_budget, slack), "k long, event_id long, budget long", "Append", "EventTime")


class HookSlot(StatefulProcessor):
    """When the run in the slot ends, how many triggers wait and how often their run will fail; a timer at the end of the run, if any wait, starts the next one."""

    def __init__(self, run_seconds: int, retries: int):
        self.run, self.allowed = run_seconds, min(retries, MOST_RETRIES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "end long, waiting long, bad long")

    def _begun(self, key, t: int, n: int, fails: int) -> tuple[int, Row]:
        attempts = min(fails, self.allowed) + 1
        return t + self.run * attempts, Row(k=key[0], start=t, n=n, attempts=attempts, ok=fails <= self.allowed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = _ordered(rows, "seconds", "fails")
        if not rows:
            return
        end, waiting, bad = self.slot.get() or (None, 0, 0)
        before = end if waiting else None
        for r in rows:
            t = r["seconds"]
            if waiting and t >= end:
                (end, run), waiting = self._begun(key, end, waiting, bad), 0
                yield run
            if end is None or t >= end:
                end, run = self._begun(key, t, 1, r["fails"])
                yield run
            else:
                bad = bad if waiting else r["fails"]
                waiting += 1
        self.slot.update((end, waiting, bad))
        now = end if waiting else None
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before * 1000)
            if now is not None:
                self.handle.registerTimer(now * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end, waiting, bad = self.slot.get()
        if waiting and end * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            end, run = self._begun(key, end, waiting, bad)
            self.slot.update((end, 0, 0))
            yield run

    def close(self) -> None:
        pass


def hook_runs(rows: DataFrame, run_seconds: int, retries: int = 0) -> DataFrame:
    """(k, start, n, attempts, ok) of the runs of a hook with one slot, from a stream of triggers (k, seconds, fails, ts). As operators.hook_runs."""
    return rows.groupBy("k").transformWithState(HookSlot(run_seconds, retries), "k long, start long, n long, attempts long, ok boolean", "Append", "EventTime")


class Advances(StatefulProcessor):
    """The last state of a key that could be read; the first one is a seed, where there is one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "state long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((initialState["state"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.known.get()[0] if self.known.exists() else None
        for r in _ordered(rows, "micros"):
            if not r["ok"] or known is None or r["state"] != known:
                yield Row(k=key[0], event_id=r["event_id"])
            if r["ok"] and r["state"] is not None:
                known = r["state"]
        if known is not None:
            self.known.update((known,))

    def close(self) -> None:
        pass


def advances(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(k, event_id) of a stream of events (k, event_id, micros, state, ok, ts) whose state isn't the last one of their key, or that couldn't be read. seeds: (k, state), each key once, for the query's first start."""
    return rows.groupBy("k").transformWithState(Advances(), "k long, event_id long", "Append", "None", initialState=seeds.groupBy("k"))


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own choice is back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def replayed(spark: SparkSession, slots: str, empty: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, stops: tuple[int, ...] = (), step: int = 1, batches: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs build over a folder of slots from sources.events.spool, whose schema empty has, and returns what came out.

    The query stops after so many slots and begins again from its checkpoint, as after a crash. Rows go to a table that takes each batch once; with batches, to that function (for foreachBatch).
    """
    schema = None
    for until in (*stops, None):
        rows = build(stream(spark, slots, empty.schema, step=str(step), **({} if until is None else {"until": str(until)})))
        schema = rows.schema
        out = rows.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
        with _rocks(spark):
            query = out.foreachBatch(batches).start() if batches else out.format("parquet").start(f"{folder}/rows")
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return None if batches else spark.read.schema(schema).parquet(f"{folder}/rows")
