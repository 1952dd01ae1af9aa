"""Queries of the batch forms of event-driven operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.registry import query
from tidemark.sources.tables import table, view, with_views
from tidemark.streaming import operators as S

_SESSIONS = """
    , o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens,
            CASE kind WHEN 'Initial' THEN 1 WHEN 'Manual' THEN 2 WHEN 'RemoteChange' THEN 3 WHEN 'Structural' THEN 4 ELSE 5 END AS r FROM triggers WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
"""


@query(with_views("triggers", sql=_SESSIONS + "SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS end, count(*) AS n, ['Initial', 'Manual', 'RemoteChange', 'Structural', 'LocalChange'][min(r)] AS kind, CASE WHEN min(r) <= 3 THEN 'full' WHEN min(r) = 4 THEN 'folders' ELSE 'paths' END AS scope FROM s GROUP BY user_id, k"))
def coalesce_triggers(spark, d):
    s = S.sessions(view(spark, d, "triggers"), "30 minutes", ["user_id"])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return s.select("user_id", micros("start"), micros("end"), "n", "kind", S.scope(F.col("kind")).alias("scope"))


@query(with_views("triggers", sql=_SESSIONS.replace("30 MINUTE", "2 HOUR") + "SELECT user_id, count(DISTINCT k) AS batches, CAST(max(k) AS BIGINT) AS last FROM s GROUP BY 1"))
def debounce_paths(spark, d):
    s = S.sessions(view(spark, d, "triggers"), "2 hours", ["user_id"])
    return s.groupBy("user_id").agg(F.count("*").alias("batches")).withColumn("last", F.col("batches"))


@query("SELECT user_id, event_id, k AS state FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS k, lag(CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR k <> p")
def state_advance(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.floor(F.get_json_object("props", "$.k").cast("long") / 10).alias("state"))
    return S.advances(e, ["user_id"], "state").select("user_id", "event_id", "state")


@query("""
    SELECT user_id, event_id, budget FROM (SELECT user_id, event_id, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap,
        coalesce(last_value(CASE WHEN p > 0 THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) + 5, 300) AS budget
        FROM (SELECT *, CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 600 END AS p FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE gap > budget * 1000000
""")
def watchdog_gaps(spark, d):
    return S.watchdog_gaps(table(spark, d, "events").withColumn("ping", ping()), ["user_id"], "ping").select("user_id", "event_id", "budget")


def ping():
    """The interval that a view announces, as a server's ping."""
    return F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("long") * 600)


@query("SELECT user_id, event_id, round(sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) / 21600.0, 9) AS rate FROM (SELECT *, CAST(floor(value) AS BIGINT) AS n FROM events)")
def rate_sliding(spark, d):
    e = table(spark, d, "events").withColumn("n", F.floor("value"))
    return S.sliding_rate(e, ["user_id"], "n", 21600).select("user_id", "event_id", F.round("rate", 9).alias("rate"))


@query("SELECT user_id, event_id, round(100 / (sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) / 21600.0), 3) AS eta FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n FROM events) QUALIFY sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) > 0")
def eta_estimate(spark, d):
    """Seconds left for a hundred items at the rate of the last six hours."""
    e = table(spark, d, "events").withColumn("n", (F.col("event_type") == "purchase").cast("int"))
    return S.sliding_rate(e, ["user_id"], "n", 21600).filter("rate > 0").select("user_id", "event_id", F.round(100 / F.col("rate"), 3).alias("eta"))


@query()
def hook_runs(spark, d):
    """Not in SQL: a state machine in order of time, held against a plain simulation in the tests."""
    return S.hook_runs(table(spark, d, "events"), "user_id", 36000)


_FILES = "SELECT doc_id, source AS folder, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'cur' END AS subdir FROM documents"


@query("SELECT doc_id AS id, CASE WHEN doc_id % 6 = 5 THEN 'deleted' WHEN doc_id % 6 = 0 THEN 'new' ELSE 'flags' END AS kind FROM documents WHERE doc_id % 6 IN (0, 2, 5)")
def scan_full_diff(spark, d):
    """A folder's files against what was known of them."""
    from tidemark.operators.reconcile import local_changes

    k = F.col("doc_id")
    f = table(spark, d, "documents").select(k, F.col("source").alias("mailbox_id"), F.concat(F.lit("m"), k.cast("string")).alias("message_id"), k.cast("string").alias("maildir_id"), F.col("n_chars").alias("size"))
    disk = f.filter("doc_id % 6 <> 5").withColumn("flags", F.when(F.col("doc_id") % 6 == 2, "S").otherwise(""))
    known = f.filter("doc_id % 6 <> 0").withColumn("flags", F.lit(""))
    return local_changes(disk.drop("doc_id"), known.drop("doc_id", "size")).select(F.col("maildir_id").cast("long").alias("id"), "kind")


@query("SELECT folder, doc_id // 3 AS id, min(CASE WHEN subdir = 'cur' THEN 0 ELSE 1 END) = 0 AS in_cur, count(*) AS files FROM (" + _FILES + ") WHERE doc_id // 3 IN (SELECT event_id // 5 FROM events WHERE event_type = 'click') GROUP BY ALL")
def scan_incremental_diff(spark, d):
    """Files of the messages that events name; one in cur stands for those in new."""
    sub = F.when(F.col("doc_id") % 10 == 0, "new").otherwise("cur")
    files = table(spark, d, "documents").select(F.col("source").alias("folder"), F.floor(F.col("doc_id") / 3).alias("id"), sub.alias("subdir"))
    named = table(spark, d, "events").filter("event_type = 'click'").select(F.floor(F.col("event_id") / 5).alias("id"))
    return files.join(named, "id", "left_semi").groupBy("folder", "id").agg((F.min(F.when(F.col("subdir") == "cur", 0).otherwise(1)) == 0).alias("in_cur"), F.count("*").alias("files"))


@query("SELECT path, count(DISTINCT k) AS batches, count(*) AS events FROM (SELECT path, sum(opens) OVER (PARTITION BY path ORDER BY ts) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM (SELECT concat(user_id, '/', event_type) AS path, ts FROM events) WINDOW w AS (PARTITION BY path ORDER BY ts))) GROUP BY 1")
def debounce_each_path(spark, d):
    """Events of one path that follow each other within the quiet time are one batch."""
    e = table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("path"), "ts", F.lit("LocalChange").alias("kind"))
    return S.sessions(e, "6 hours", ["path"]).groupBy("path").agg(F.count("*").alias("batches"), F.sum("n").alias("events"))


@query(with_views("triggers", sql=_SESSIONS.replace("30 MINUTE", "6 HOUR") + """
    SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n, ['Initial', 'Manual', 'RemoteChange', 'Structural', 'LocalChange'][min(r)] AS kind,
           coalesce(CASE WHEN min(r) = 4 THEN string_agg(concat('c', event_id), ',' ORDER BY event_id) FILTER (r = 4) END, '') AS candidates, coalesce(CASE WHEN min(r) >= 4 THEN string_agg(concat('p', event_id % 7), ',' ORDER BY concat('p', event_id % 7)) FILTER (r >= 4) END, '') AS paths
    FROM s GROUP BY user_id, k
"""))
def coalesce_paths(spark, d):
    """Runs of triggers with the paths that they carry; repeats stay."""
    k = F.col("event_id")
    t = view(spark, d, "triggers").withColumn("candidates", F.array(F.concat(F.lit("c"), k.cast("string")))).withColumn("paths", F.array(F.concat(F.lit("p"), (k % 7).cast("string"))))
    f = S.folded(t, "6 hours", ["user_id"])
    by_number = F.array_join(F.transform(F.array_sort(F.transform("candidates", lambda x: F.substring(x, 2, 20).cast("long"))), lambda x: F.concat(F.lit("c"), x.cast("string"))), ",")
    return f.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n", "kind", by_number.alias("candidates"), F.array_join(F.array_sort("paths"), ",").alias("paths"))


@query("""
    WITH e AS (SELECT event_id // 4 AS batch, event_id % 6 AS k, event_id % 5 <> 0 AS here, event_id % 12 = 10 AS hit FROM events),
    g AS (SELECT batch, bool_or(k = 0 OR k = 1 AND NOT here) AND batch % 9 <> 0 AS live, bool_or(k = 4 AND hit) AS fires, count(*) FILTER (k IN (0, 1)) AS m, count(*) FILTER (k = 4) AS c FROM e GROUP BY 1)
    SELECT batch, CASE WHEN fires THEN 'Structural' ELSE 'LocalChange' END AS kind, CASE WHEN fires THEN c ELSE 0 END AS candidates, CASE WHEN live THEN m ELSE 0 END AS paths FROM g WHERE fires OR live
""")
def batch_classes(spark, d):
    """Batches of file events: structural ones, ones with messages, ones of nothing (new files that are still there, own writes, other files)."""
    k, b = F.col("event_id"), F.floor(F.col("event_id") / 4)
    at = lambda p: F.concat(F.lit(p), k.cast("string"))
    path = F.when(k % 6 == 0, at("a/cur/")).when(k % 6 == 1, at("a/new/")).when(k % 6 == 4, at("a/b")).when(k % 6 == 5, at("a/cur/x")).otherwise(at(".tidemark.x/"))
    structural = F.when(T.is_structural_path(path), T.fires(path, k % 5 != 0, F.lit(True), k % 12 == 10))
    e = table(spark, d, "events").select(b.alias("batch"), path.alias("path"), (k % 5 != 0).alias("exists"), structural.alias("fires"))
    own = e.filter("batch % 9 = 0").select("batch").distinct()
    return S.classified(e, own).select("batch", "kind", F.size("candidates").cast("long").alias("candidates"), F.size("paths").cast("long").alias("paths"))


@query(with_views("cached", sql="SELECT maildir_id, CASE WHEN contains(flags, 'S') THEN concat('d/cur/', maildir_id, ':2,', flags) ELSE concat('d/new/', maildir_id, ':2,', flags, ' d/cur/', maildir_id, ':2,', flags) END AS paths FROM cached"))
def predicted_paths(spark, d):
    return view(spark, d, "cached").select("maildir_id", F.array_join(S.predicted_paths(F.lit("d"), F.col("maildir_id"), F.col("flags")), " ").alias("paths"))


@query("""
    WITH p AS (SELECT user_id, event_id, ts + INTERVAL 20 MINUTE AS probe FROM events WHERE event_id % 5 = 0),
    j AS (SELECT p.user_id, p.event_id, p.probe, count(*) FILTER (e.ts >= p.probe - INTERVAL 6 HOUR) AS n, max(e.ts) AS newest, count(*) AS total FROM p JOIN events e ON e.user_id = p.user_id AND e.ts <= p.probe GROUP BY ALL)
    SELECT user_id, epoch_us(probe) AS probe, round(CASE WHEN newest >= probe - INTERVAL 1 HOUR THEN n / 21600.0 ELSE 0 END, 9) AS rate, total FROM j
""")
def rate_idle(spark, d):
    """Rates of the last six hours as seen at probes; nothing is going on an hour after the newest sample."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.lit(1).cast("bigint").alias("n"))
    probes = e.filter("event_id % 5 = 0").select("user_id", (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("ts"))
    r = S.rates_at(e, probes, ["user_id"], "n", 21600, 3600)
    return r.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("probe"), F.round("rate", 9).alias("rate"), "total")


@query("""
    WITH j AS (SELECT p.user_id, p.event_id, p.ts, count(*) FILTER (e.ts >= p.ts - INTERVAL 12 HOUR) AS n, max(e.ts) AS newest FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts <= p.ts AND e.event_type IN ('click', 'view') WHERE p.event_type = 'purchase' GROUP BY ALL)
    SELECT user_id, epoch_us(ts) AS at, round(100 / (n / 43200.0), 3) AS eta FROM j WHERE newest >= ts - INTERVAL 3 HOUR AND n > 0
""")
def eta_idle(spark, d):
    """Seconds left at the rate at which incoming transfers were closed, where one was lately; outgoing ones don't count."""
    e = table(spark, d, "events").withColumn("n", F.lit(1).cast("bigint"))
    r = S.rates_at(e.filter("event_type IN ('click', 'view')"), e.filter("event_type = 'purchase'"), ["user_id"], "n", 43200, 10800)
    return S.eta(r.withColumn("left", F.lit(100)), "left").filter("eta IS NOT NULL").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.round("eta", 3).alias("eta"))


@query("""
    SELECT user_id, event_id FROM (SELECT user_id, event_id, ok, k, coalesce(last_value(CASE WHEN ok THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN user_id % 2 = 0 THEN 3 END) AS p
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS k, event_type <> 'error' AS ok FROM events)) WHERE NOT ok OR p IS NULL OR k <> p
""")
def state_advance_seeded(spark, d):
    """Advances over states that were kept from before; an event that can't be read always counts."""
    e, seeds = seeded(spark, d)
    return S.advances(e, ["user_id"], "state", seeds=seeds, valid="ok").select("user_id", "event_id")


def seeded(spark, d):
    """Events with their state and whether it can be read; states kept from before."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.floor(F.get_json_object("props", "$.k").cast("long") / 10).alias("state"), (F.col("event_type") != "error").alias("ok"))
    return e, e.filter("user_id % 2 = 0").select("user_id", F.lit(3).cast("long").alias("state")).distinct()


@query("""
    WITH m AS (SELECT user_id, event_id // 3 AS batch, event_type, bool_or(event_id % 4 <> 0) AS w FROM events GROUP BY ALL)
    SELECT user_id, batch, bool_and(w) AS own FROM m GROUP BY ALL
""")
def own_batches(spark, d):
    """Batches of paths of which each was written here a minute before."""
    return S.own_batches(*own_parts(spark, d), "user_id", 3600)


def own_parts(spark, d):
    """Batches (user_id, batch, path, ts), and the writes of some of their paths a minute before their end."""
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 3).alias("batch"), "event_type", "ts")
    path = F.concat(F.col("batch").cast("string"), F.lit("/"), F.col("event_type"))
    last = e.groupBy("user_id", "batch").agg(F.max("ts").alias("t"))
    writes = e.filter("event_id % 4 <> 0").join(last, ["user_id", "batch"]).select("user_id", path.alias("path"), (F.col("t") - F.expr("INTERVAL 1 MINUTE")).alias("ts"))
    return e.select("user_id", "batch", path.alias("path"), "ts"), writes


@query()
def hook_retries(spark, d):
    """Not in SQL: runs that fail and are tried again, held against a plain simulation in the tests."""
    e = table(spark, d, "events").withColumn("fails", F.col("event_id") % 4)
    return S.hook_runs(e, "user_id", 7200, fails="fails", retries=2)


@query("""
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN FALSE WHEN 1 THEN event_id % 5 = 0 OR event_id % 3 <> 0 WHEN 2 THEN event_id % 5 = 0 OR event_id % 3 <> 0 WHEN 3 THEN event_id % 5 = 0 OR event_id % 3 <> 0 ELSE event_id % 11 = 1 END AS fires FROM events
""")
def structural_fires(spark, d):
    """Whether events of folders' own paths mean a change: the root never does, cur, new and tmp do if they are gone or their folder has no sentinel, others if they are maildirs."""
    k = F.col("event_id")
    path = F.when(k % 7 == 0, "").when(k % 7 == 1, "a/cur").when(k % 7 == 2, "a/b/new").when(k % 7 == 3, "tmp").when(k % 7 == 4, "a").otherwise("a/b.cur")
    return table(spark, d, "events").select("event_id", T.fires(path, k % 5 != 0, k % 3 == 0, k % 11 == 1).alias("fires"))
