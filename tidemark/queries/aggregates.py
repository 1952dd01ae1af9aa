"""Queries of transfer profiles, rates, totals and sample statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ordered, store
from tidemark.registry import query
from tidemark.sources.tables import table, view, with_views
from tidemark.streaming import operators as S


@query(with_views("transfers", sql="SELECT direction, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(bytes) AS BIGINT) AS largest FROM transfers GROUP BY 1"))
def profile_blob(spark, d):
    return view(spark, d, "transfers").groupBy("direction").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS store, count(*) FILTER (event_type = 'view') AS flags, count(*) FILTER (event_type = 'purchase') AS move, count(*) AS total FROM events GROUP BY 1")
def profile_fileops(spark, d):
    n = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, d, "events").groupBy("user_id").agg(n("click").alias("store"), n("view").alias("flags"), n("purchase").alias("move"), F.count("*").alias("total"))


@query(with_views("transfers", sql="SELECT direction, phase, round(CASE WHEN count(DISTINCT ts) > 1 THEN sum(bytes) * 1000.0 / (count(DISTINCT ts) - 1) ELSE 0 END, 3) AS rate, count(*) AS ops FROM transfers GROUP BY ALL"))
def profile_rate(spark, d):
    """Bytes times 1,000 by the phase's length; 0 for a phase of no length."""
    t = view(spark, d, "transfers").groupBy("direction", "phase").agg(F.sum("bytes").alias("b"), (F.countDistinct("ts") - 1).alias("ms"), F.count("*").alias("ops"))
    return t.select("direction", "phase", F.round(F.when(F.col("ms") > 0, F.col("b") * 1000.0 / F.col("ms")).otherwise(0.0), 3).alias("rate"), "ops")


@query(with_views("transfers", sql="SELECT year(ts) AS cycle, direction, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM transfers GROUP BY ALL"))
def profile_cycles(spark, d):
    return view(spark, d, "transfers").groupBy(F.year("ts").cast("long").alias("cycle"), "direction").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT s_nationkey AS cell, round(avg(s_acctbal), 2) AS mean, round(coalesce(stddev_samp(s_acctbal), 0), 2) AS sd, min(s_acctbal) AS lo, max(s_acctbal) AS hi, count(*) AS n FROM supplier GROUP BY 1")
def bench_summary(spark, d):
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("cell")).agg(
        F.round(F.avg(x), 2).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 2).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n")
    )


@query("SELECT user_id % 10 AS run, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS joules, count(*) AS samples FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def energy_sum(spark, d):
    """Sum of the rightmost number of each matching line, and how many lines there are."""
    k = F.get_json_object("props", "$.k")
    line = F.concat(F.lit("power 7 "), F.when(F.col("event_id") % 2 == 0, F.concat(k, F.lit(" mJ"))).otherwise("none"))
    numbers = F.filter(F.split(line, " "), lambda t: t.rlike("^[0-9]+$"))
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("run"), F.when(line.endswith("mJ"), F.element_at(numbers, -1).cast("long")).alias("v")).filter("v IS NOT NULL")
    return rows.groupBy("run").agg(F.sum("v").alias("joules"), F.count("*").alias("samples"))


@query("SELECT user_id, max(ts) AS updated_at, CASE WHEN max(CASE WHEN event_type = 'error' THEN ts END) = max(ts) THEN 'reset' ELSE 'ok' END AS cursor FROM events GROUP BY 1")
def cursor_status(spark, d):
    """Latest update of each account, and whether its cursor was emptied then."""
    state = F.when(F.col("event_type") == "error", "").otherwise("s")
    g = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.max_by(F.nullif(state, F.lit("")), "ts").alias("s"))
    return g.select("user_id", "updated_at", F.when(F.col("s").isNull(), "reset").otherwise("ok").alias("cursor"))


@query("SELECT event_type, user_id % 5 AS channel, arg_max(event_id, ts) AS last_event FROM events GROUP BY ALL")
def channel_health(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("channel")).agg(F.max_by("event_id", "ts").alias("last_event"))


@query("SELECT source AS folder, md5(text) AS message_id, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY ALL")
def known_index(spark, d):
    """Messages of a folder by their id, with all files in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, d, "documents").groupBy(F.col("source").alias("folder"), F.md5("text").alias("message_id")).agg(F.count("*").alias("n"), ids.alias("ids"))


@query("SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents")
def prefix_offsets(spark, d):
    return store.numbered(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), "start").select("source", "doc_id", "start")


_WORK = """
    WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'fetch' ELSE 'execute' END AS name, o_orderkey % 7 * 1500 AS ms FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0)
"""


def _phases(spark, d):
    """Phases of orders: those of 5 never end, those of 11 have an end alone."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, "fetch").otherwise("execute").alias("name"), F.col("o_orderdate").cast("timestamp").alias("ts"), (k % 7 * 1500).alias("ms"))
    end = F.timestamp_micros(F.unix_micros("ts") + F.col("ms") * 1000)
    return S.phases(o.filter("id % 11 <> 0").select("id", "name", F.lit("begin").alias("edge"), "ts").union(o.filter("id % 5 <> 0").select("id", "name", F.lit("end"), end)))


@query(_WORK + "SELECT id, name, ms AS millis FROM p")
def phase_durations(spark, d):
    """The length of each phase, by the end that its id has."""
    return _phases(spark, d).select("id", "name", "millis")


@query(_WORK + """
    , w AS (SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) AS ops FROM lineitem GROUP BY 1)
    SELECT w.id, bytes, ops, CASE WHEN ms > 0 THEN bytes * 1000 // ms ELSE 0 END AS byte_rate, CASE WHEN ms > 0 THEN ops * 1000 // ms ELSE 0 END AS op_rate FROM w LEFT JOIN (SELECT * FROM p WHERE name = 'execute') USING (id)
""")
def phase_rates(spark, d):
    """Bytes and operations a second over the phase in which they were carried out."""
    work = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"), F.count("*").alias("ops"))
    return S.phase_rates(work, _phases(spark, d).filter("name = 'execute'"))


_EDGES = """
    WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('view', 'signup') THEN 1 WHEN event_type IN ('click', 'error') THEN -1 END AS step FROM events WHERE event_type <> 'purchase'),
    s AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e),
    f AS (SELECT *, min(s - step) OVER (PARTITION BY user_id ORDER BY ts) AS floor FROM s),
    l AS (SELECT *, s - floor + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level FROM f),
    o AS (SELECT *, lag(event_id) OVER w AS opener, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM l WHERE level > 0 WINDOW w AS (PARTITION BY user_id, floor, level ORDER BY ts))
"""


@query(_EDGES + "SELECT user_id, event_id AS closer, opener, us // 1000 AS millis FROM o WHERE step < 0")
def nested_phases(spark, d):
    """Phases of users that open again before they are closed: each closing with what it closes."""
    kind = F.col("event_type")
    e = table(spark, d, "events").filter("event_type <> 'purchase'").select("user_id", "event_id", "ts", S.micros("ts").alias("at"), kind)
    done = ordered.nested(e, "user_id", ["at"], kind.isin("view", "signup"), F.struct("event_id", "at"), ordered.WHOLE)
    return done.select("user_id", F.col("event_id").alias("closer"), F.col("opened.event_id").alias("opener"), F.floor((F.col("at") - F.col("opened.at")) / 1000).alias("millis"))


_CHAIN = """
    WITH e AS (SELECT conv_id, turn AS old, turn + 1 AS new FROM conversations WHERE NOT (conv_id % 9 = 0 AND turn = 2)),
    n AS (SELECT conv_id, count(*) AS edges, min(old) AS first FROM e GROUP BY 1)
"""


@query(_CHAIN + "SELECT conv_id, first + edges AS reached, first = 0 AND (SELECT max(new) FROM e WHERE e.conv_id = n.conv_id) = first + edges AS whole FROM n WHERE (SELECT max(new) FROM e WHERE e.conv_id = n.conv_id) = first + edges")
def cursor_chain(spark, d):
    """Conversations whose edges, turn to turn, form one chain, and where it ends: every edge is used exactly once."""
    e = table(spark, d, "conversations").filter(~((F.col("conv_id") % 9 == 0) & (F.col("turn") == 2))).select("conv_id", F.col("turn").alias("old"), (F.col("turn") + 1).alias("new"))
    n = e.groupBy("conv_id").agg(F.count("*").alias("edges"), F.countDistinct("old").alias("starts"), F.min("old").alias("first"), F.max("new").alias("last"))
    whole = (F.col("edges") == F.col("starts")) & (F.col("last") - F.col("first") == F.col("edges"))
    return n.filter(whole).select("conv_id", F.col("last").alias("reached"), (F.col("first") == 0).alias("whole"))


_CHUNKS = """
    WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 <> 3 OR turn <> 1 THEN concat('s', turn) END AS old, CASE WHEN conv_id % 5 <> 2 OR turn <> 0 THEN concat('s', turn + 1) END AS new FROM conversations WHERE NOT (conv_id % 9 = 0 AND turn = 2)),
    w AS (SELECT *, old IS NOT NULL AND new IS NOT NULL AS whole FROM c),
    b AS (SELECT *, last_value(CASE WHEN whole THEN new END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
"""


@query(_CHUNKS + """
    SELECT conv_id, arg_min(old, turn) FILTER (whole) AS old, CASE WHEN NOT coalesce(bool_or(before IS NOT NULL AND (NOT whole OR old <> before)), FALSE) THEN arg_max(new, turn) FILTER (whole) END AS new FROM b GROUP BY 1
""")
def cursor_chunk_merge(spark, d):
    """Where the chain of each conversation's chunks begins, and where it leads unless it breaks. Some chunks are missing, some lack a state."""
    k, t = F.col("conv_id"), F.col("turn")
    at = lambda n: F.concat(F.lit("s"), n.cast("string"))
    c = table(spark, d, "conversations").filter(~((k % 9 == 0) & (t == 2)))
    chunks = c.select(k, t, F.when((k % 7 != 3) | (t != 1), at(t)).alias("old"), F.when((k % 5 != 2) | (t != 0), at(t + 1)).alias("new"))
    return ordered.merged_chain(chunks, ["conv_id"], "turn")


@query("SELECT l_orderkey, l_linenumber, 'P' || p_partkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
def resolve_refs(spark, d):
    """Uploads into mailboxes that are made in the same cycle, with the id that each got; those of one that wasn't made are left out."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = table(spark, d, "part").filter("p_size > 25").select(name("#", "p_partkey").alias("ref"), name("P", "p_partkey").alias("id"))
    return store.resolved(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name("#", "l_partkey").alias("ref")), made).select("l_orderkey", "l_linenumber", "target")


@query("""
    SELECT user_id, event_id, CAST(least(1000 * power(2, k - 1), 60000) AS BIGINT) AS wait_ms FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts) AS k FROM (
            SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts) AS run FROM events) WHERE event_type = 'error')
""")
def backoff_schedule(spark, d):
    """The wait after each failure: doubled for each one since the last success, up to a minute."""
    bad = F.col("event_type") == "error"
    e = table(spark, d, "events").select("user_id", "event_id", S.micros("ts").alias("at"), bad.alias("bad"))
    e = ordered.scan(e, ["user_id"], ["at"], failures=("sum", F.col("bad").cast("int")))
    e = ordered.scan(e, ["user_id"], ["at"], settled=("last", F.when(~F.col("bad"), F.col("failures")))).filter("bad")
    k = F.col("failures") - F.coalesce("settled", F.lit(0))
    return e.select("user_id", "event_id", F.least(F.pow(F.lit(2.0), k - 1) * 1000, F.lit(60000.0)).cast("long").alias("wait_ms"))


@query("SELECT user_id, greatest(8 >> CAST(least(count(*) FILTER (event_type = 'error'), 3) AS INTEGER), 1) AS workers FROM events GROUP BY 1")
def concurrency_halving(spark, d):
    """Of eight workers, how many are left when each rate limit halves them."""
    n = F.least(F.count_if(F.col("event_type") == "error"), F.lit(3))
    return table(spark, d, "events").groupBy("user_id").agg(F.greatest(F.floor(8 / F.pow(F.lit(2), n)), F.lit(1)).cast("long").alias("workers"))
