"""Event-driven operators. Each takes and returns DataFrames; those on windows also run on streams.

Streams need event times with a zone and a bound for late rows, which the batch forms don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_message_path
from tidemark.operators import ordered

#: The kinds of triggers, the most important first, and what they have scanned.
DOMINANCE = ("Initial", "Manual", "RemoteChange", "Structural", "LocalChange")


def sessions(triggers: DataFrame, gap: str, keys: list[str], watermark: str | None = None, time: str = "ts") -> DataFrame:
    """(keys, start, end, n, kind) of runs of triggers that follow each other within gap; the run has its most important trigger's kind.

    For a stream give the watermark; the result comes in append mode when a run is over.
    """
    if watermark:
        triggers = triggers.withWatermark(time, watermark)
    rank = F.array_position(F.array(*[F.lit(k) for k in DOMINANCE]), F.col("kind"))
    g = triggers.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.min(rank).alias("_rank"), F.max(time).alias("end"))
    return g.select(*keys, F.col("w.start").alias("start"), "end", "n", F.element_at(F.array(*[F.lit(k) for k in DOMINANCE]), F.col("_rank").cast("int")).alias("kind"))


def folded(triggers: DataFrame, gap: str, keys: list[str], watermark: str | None = None, time: str = "ts") -> DataFrame:
    """sessions of triggers (kind, candidates, paths: arrays) with the paths that their runs carry: those of structural and local changes, one after
    another, repeats and all. A run that scans everything needs none; a structural one has candidates of its kind and everybody's paths; a local one paths alone."""
    if watermark:
        triggers = triggers.withWatermark(time, watermark)
    rank = F.array_position(F.array(*[F.lit(k) for k in DOMINANCE]), F.col("kind"))
    g = triggers.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(
        F.min(rank).cast("int").alias("_rank"), F.count("*").alias("n"), F.flatten(F.collect_list(F.when(F.col("kind") == "Structural", F.col("candidates")))).alias("_c"),
        F.flatten(F.collect_list(F.when(F.col("kind").isin("Structural", "LocalChange"), F.col("paths")))).alias("_p"),
    )
    none = F.array().cast("array<string>")
    kind = F.element_at(F.array(*[F.lit(k) for k in DOMINANCE]), F.col("_rank"))
    return g.select(*keys, F.col("w.start").alias("start"), "n", kind.alias("kind"), F.when(F.col("_rank") == 4, F.col("_c")).otherwise(none).alias("candidates"), F.when(F.col("_rank") >= 4, F.col("_p")).otherwise(none).alias("paths"))


def classified(events: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(batch, kind, candidates, paths) of batches of events (batch, path, exists, fires): what a batch of file events triggers.

    Message paths count only if one of them is in cur or gone, and not all are own writes (own: batch). Of other paths those that can be
    structural come (null in fires: they can't); if one fires, the batch is structural, else only its messages count. Batches of neither are left out.
    """
    message = is_message_path(F.col("path"))
    lively = F.contains("path", F.lit("/cur/")) | ~F.col("exists")
    g = events.groupBy("batch").agg(
        F.array_sort(F.collect_list(F.when(message, F.col("path")))).alias("_m"), F.coalesce(F.bool_or(F.when(message, lively)), F.lit(False)).alias("_live"),
        F.array_sort(F.collect_list(F.when(~message & F.col("fires").isNotNull(), F.col("path")))).alias("_c"), F.coalesce(F.bool_or(F.when(~message, F.col("fires"))), F.lit(False)).alias("_fires"),
    )
    if own is not None:
        g = g.join(own.select("batch", F.lit(True).alias("_own")).distinct(), "batch", "left").withColumn("_live", F.col("_live") & F.col("_own").isNull())
    none = F.array().cast("array<string>")
    rows = g.select("batch", F.when(F.col("_fires"), "Structural").when(F.col("_live"), "LocalChange").alias("kind"), F.when(F.col("_fires"), F.col("_c")).otherwise(none).alias("candidates"), F.when(F.col("_live"), F.col("_m")).otherwise(none).alias("paths"))
    return rows.filter("kind IS NOT NULL")


def predicted_paths(folder: Column, maildir_id: Column, flags: Column) -> Column:
    """Paths under which a delivery will be seen: read ones in cur; others in new, and in cur once a reader takes them there with the same flags."""
    name = F.concat(maildir_id, F.lit(":2,"), flags)
    at = lambda sub: F.concat(folder, F.lit(f"/{sub}/"), name)
    return F.when(F.contains(flags, F.lit("S")), F.array(at("cur"))).otherwise(F.array(at("new"), at("cur")))


def on_changes(handler: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: handler is only called for batches that have rows."""
    def call(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            handler(batch, batch_id)

    return call


def scope(kind: Column) -> Column:
    return F.when(kind.isin("Initial", "Manual", "RemoteChange"), "full").when(kind == "Structural", "folders").otherwise("paths")


def advances(events: DataFrame, keys: list[str], state: str, time: str = "ts", seeds: DataFrame | None = None, valid: str | None = None) -> DataFrame:
    """Events whose state isn't that of the one before with the same keys; the first one counts, unless seeds (keys, state) has its state.

    valid: a column that says whether the event could be read. One that couldn't always counts, and leaves the state as it was.
    """
    own = F.struct(F.col(state).alias("s")) if valid is None else F.when(F.col(valid) & F.col(state).isNotNull(), F.struct(F.col(state).alias("s")))
    rows = ordered.scan(events.withColumn("_micros", micros(time)), keys, ["_micros"], _b=("before", own))
    if seeds is not None:
        rows = rows.join(seeds.select(*keys, F.struct(F.col(state).alias("s")).alias("_seed")), keys, "left").withColumn("_b", F.coalesce("_b", "_seed")).drop("_seed")
    changed = ~F.col(state).eqNullSafe(F.col("_b.s"))
    if valid is None:
        changed = changed | F.col("_b").isNull()
    return rows.filter(changed if valid is None else changed | ~F.col(valid)).select(*events.columns)


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def watchdog_gaps(events: DataFrame, keys: list[str], ping: str, time: str = "ts", first_budget: int = 300, slack: int = 5) -> DataFrame:
    """Events that none follows in time: within the interval of the last valid ping and some slack, or first_budget seconds before there is one."""
    w = Window.partitionBy(*keys).orderBy(time)
    budget = F.coalesce(F.last(F.when(F.col(ping) > 0, F.col(ping)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + slack, F.lit(first_budget))
    seconds = F.unix_micros(F.lead(time).over(w).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("_gap", seconds).withColumn("budget", budget).filter(F.col("_gap") > F.col("budget") * 1_000_000).drop("_gap")


def sliding_rate(samples: DataFrame, keys: list[str], amount: str, seconds: int, time: str = "ts") -> DataFrame:
    """samples with rate: what came within the last seconds, by that fixed time."""
    order = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-seconds * 1_000_000, 0)
    return samples.withColumn("rate", F.sum(amount).over(w) / seconds)


def rates_at(samples: DataFrame, probes: DataFrame, keys: list[str], amount: str, seconds: int, idle: int, time: str = "ts") -> DataFrame:
    """probes (keys, time) with rate (what came within the last seconds, by that fixed time; 0 if the newest sample is more than idle seconds old) and total (all that came so far).

    What came within a window is what came up to the probe without what came up to a mark before the window: all three are rows of one scan.
    """
    kind = samples.schema[amount].dataType
    row = lambda rows, at, n, what: rows.select(*keys, time, at.alias("_at"), n.cast(kind).alias("_n"), F.lit(what).alias("_what"))
    probes = probes.select(*keys, time).filter(F.col(time).isNotNull())
    both = row(samples.filter(F.col(time).isNotNull()), micros(time), F.col(amount), 0).union(row(probes, micros(time) - (seconds * 1_000_000 + 1), F.lit(None), 1)).union(row(probes, micros(time), F.lit(None), 2))
    came = F.when(F.col("_what") == 0, F.col("_at"))
    rows = ordered.scan(both, keys, ["_at", "_what"], _sum=("sum", F.col("_n")), _last=("max", came)).filter("_what > 0")
    at = lambda what, c: F.max(F.when(F.col("_what") == what, F.col(c)))
    # A mark and its probe meet by time; of probes that share one, each has as many rows as there are.
    g = rows.groupBy(*keys, time).agg(at(2, "_sum").alias("total"), at(1, "_sum").alias("_old"), at(2, "_last").alias("_last"), F.count_if(F.col("_what") == 2).cast("int").alias("_times"))
    rate = F.when(micros(time) - F.col("_last") <= idle * 1_000_000, (F.col("total") - F.coalesce("_old", F.lit(0))) / seconds).otherwise(F.lit(0.0))
    g = g.withColumn("rate", rate).withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return g.select(*keys, time, "rate", "total")


def eta(rates: DataFrame, left: str) -> DataFrame:
    """rates with eta: seconds that what is left takes at the rate; null at rate 0."""
    return rates.withColumn("eta", F.when(F.col("rate") > 0, F.col(left) / F.col("rate")))


def own_batches(batches: DataFrame, written: DataFrame, key: str, ttl: int, time: str = "ts") -> DataFrame:
    """(key, batch, own) of batches (key, batch, path, time) against written (key, path, time): own if each path of the batch was written here less than ttl
    seconds before its last event; then its entries are used up. A path written again is remembered from then on.

    A key's events go through one task in order; what is held are its writes of the last ttl seconds.
    """
    def step(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, entries, gc_at = None, {}, 0
        for pdf in pdfs:
            out = []
            for k, t, batch, paths in zip(pdf["k"], pdf["t"], pdf["batch"], pdf["paths"], strict=True):
                if k != key_now:
                    key_now, entries, gc_at = k, {}, t
                if batch < 0:
                    entries.update((p, t) for p in paths)
                    if t >= gc_at + ttl * 1_000_000:
                        entries, gc_at = {p: u for p, u in entries.items() if t - u < ttl * 1_000_000}, t
                else:
                    own = all(p in entries and t - entries[p] < ttl * 1_000_000 for p in paths)
                    if own:
                        for p in paths:
                            entries.pop(p, None)
                    out.append((k, batch, own))
            yield pd.DataFrame(out, columns=["k", "batch", "own"])

    micros = F.unix_micros(F.col(time).cast("timestamp"))
    whole = batches.groupBy(F.col(key).cast("long").alias("k"), F.col("batch").cast("long").alias("batch")).agg(F.max(micros).alias("t"), F.collect_set("path").alias("paths"))
    notes = written.select(F.col(key).cast("long").alias("k"), F.lit(-1).cast("long").alias("batch"), micros.alias("t"), F.array("path").alias("paths"))
    rows = notes.unionByName(whole).repartition("k").sortWithinPartitions("k", "t", "batch")
    return rows.select("k", "t", "batch", "paths").mapInPandas(step, "k long, batch long, own boolean").withColumnRenamed("k", key)


#: Fixed value: a hook is tried again this often at most.
MOST_RETRIES = 10


def hook_runs(triggers: DataFrame, key: str, run_seconds: int, time: str = "ts", fails: str | None = None, retries: int = 0) -> DataFrame:
    """(key, start, triggers) of runs of a hook that has one slot: triggers while it runs make one further run right after it.

    fails: a column with how often a run that this trigger begins fails (for a further run: its first trigger); each failure is followed by another try of
    run_seconds, up to retries (MOST_RETRIES at most), and the runs have attempts and ok as well. A key's triggers go through one task in
    order, a bounded state at a time.
    """
    allowed = min(retries, MOST_RETRIES)

    def step(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key_now, end, waiting, bad = None, 0, 0, 0

        def begin(t: int, n: int, f: int) -> int:
            attempts = min(f, allowed) + 1
            out.append((key_now, t, n, attempts, f <= allowed))
            return t + run_seconds * attempts

        for pdf in pdfs:
            for k, t, f in zip(pdf["k"], pdf["t"], pdf["f"], strict=True):
                if k != key_now:
                    if waiting:
                        begin(end, waiting, bad)
                    key_now, waiting = k, 0
                    end = begin(t, 1, f)
                    continue
                if waiting and t >= end:
                    end, waiting = begin(end, waiting, bad), 0
                if t >= end:
                    end = begin(t, 1, f)
                else:
                    bad = bad if waiting else f
                    waiting += 1
            yield pd.DataFrame(out, columns=["k", "start", "n", "attempts", "ok"])
            out.clear()
        if waiting:
            begin(end, waiting, bad)
        yield pd.DataFrame(out, columns=["k", "start", "n", "attempts", "ok"])

    failures = F.lit(0).cast("long") if fails is None else F.coalesce(F.col(fails).cast("long"), F.lit(0))
    rows = triggers.select(F.col(key).cast("long").alias("k"), F.unix_timestamp(F.col(time).cast("timestamp")).alias("t"), failures.alias("f"))
    runs = rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(step, "k long, start long, n long, attempts long, ok boolean")
    own = [] if fails is None else ["attempts", "ok"]
    return runs.select(F.col("k").alias(key), "start", F.col("n").alias("triggers"), *own)


def phases(events: DataFrame, time: str = "ts") -> DataFrame:
    """(id, name, begin, millis) of phases from events (id, name, edge 'begin' or 'end', time). An id may begin again before its end: an end closes the phase that began last
    under its id and is still open. At one time phases begin before others end. Ends of nothing and phases that never end are left out."""
    rows = events.withColumn("_micros", micros(time)).filter("_micros IS NOT NULL")
    done = ordered.nested(rows, "id", ["_micros", "edge"], F.col("edge") == "begin", F.struct(F.col("_micros").alias("t"), "name", F.col(time).alias("begin")), ordered.WHOLE)
    return done.select("id", F.col("opened.name").alias("name"), F.col("opened.begin").alias("begin"), F.floor((F.col("_micros") - F.col("opened.t")) / 1000).alias("millis"))


def phase_rates(work: DataFrame, phase: DataFrame) -> DataFrame:
    """work (id, bytes, ops) with byte_rate and op_rate: by the length of the phase (id, millis), per second; 0 for a phase of no length or none."""
    rows = work.join(phase.groupBy("id").agg(F.min("millis").alias("millis")), "id", "left")
    rate = lambda c: F.when(F.coalesce("millis", F.lit(0)) > 0, F.floor(F.col(c) * 1000 / F.col("millis"))).otherwise(F.lit(0)).cast("long")
    return rows.select("id", "bytes", "ops", rate("bytes").alias("byte_rate"), rate("ops").alias("op_rate"))
