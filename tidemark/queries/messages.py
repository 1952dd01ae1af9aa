"""Queries over stored messages: duplicates, lookups, predicates by folder and batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import dedupe, store
from tidemark.registry import query
from tidemark.sources.tables import table, view, with_views

_KEPT = """
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, message_id ORDER BY mtime, maildir_id) AS r,
                 first_value(maildir_id) OVER (PARTITION BY folder, message_id ORDER BY mtime, maildir_id) AS kept_id FROM messages)
"""


@query(with_views("messages", sql=_KEPT + "SELECT folder, message_id, maildir_id, kept_id FROM ranked WHERE r > 1"))
def dedupe_plan(spark, d):
    return dedupe.dedupe_plan(view(spark, d, "messages"))


def _named(spark, d):
    """Messages in two folders, some of whose names extend another's."""
    m = view(spark, d, "messages")
    name = F.concat(F.lit("m"), F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 6 == 1, ",S=1").when(F.col("doc_id") % 6 == 3, "").otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string"))))
    sub = F.when(F.col("doc_id") % 2 == 0, "new").otherwise("cur")
    return m.select("doc_id", (F.col("doc_id") % 2).alias("folder"), F.floor(F.col("doc_id") / 2).alias("message_id"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("m"), F.floor(F.col("doc_id") / 2).cast("string"))).otherwise(name).alias("maildir_id"), sub.alias("subdir"))


@query("SELECT doc_id // 2 AS message_id FROM documents GROUP BY 1 HAVING count(*) = 2 AND min(doc_id) % 6 = 0")
def dedupe_exempt(spark, d):
    return dedupe.exempt_groups(_named(spark, d), ["message_id"])


_REMOTE = """
    , g AS (SELECT source, n_chars % 50 AS k, count(*) AS n, CASE WHEN count(*) = 1 THEN 'single' WHEN min(n_chars) <> max(n_chars) THEN 'size mismatch'
       WHEN min(sha256(text)) <> max(sha256(text)) THEN 'content mismatch' ELSE 'matched' END AS verdict FROM documents GROUP BY ALL)
    , exact AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1)
"""


def _remote(spark, d):
    return table(spark, d, "documents").withColumn("k", F.col("n_chars") % 50), ["source", "k"], F.col("n_chars"), F.sha2("text", 256)


@query("WITH " + _REMOTE.lstrip().lstrip(",") + "SELECT * FROM g")
def remote_dedupe_verdict(spark, d):
    return dedupe.remote_verdicts(*_remote(spark, d))


@query("""
    WITH m AS (SELECT doc_id, sha256(text) AS h, doc_id IN (SELECT doc_id FROM labels) AS bound FROM documents),
    r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY bound DESC, doc_id) AS survivor, count(*) OVER (PARTITION BY h) AS n FROM m)
    SELECT h, doc_id, survivor FROM r WHERE n > 1 AND doc_id <> survivor
""")
def remote_dedupe_plan(spark, d):
    docs = table(spark, d, "documents")
    bound = table(spark, d, "labels").select("doc_id", F.lit(True).alias("bound")).distinct()
    m = docs.withColumn("h", F.sha2("text", 256)).select("doc_id", "h", "n_chars").join(bound, "doc_id", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
    return dedupe.remote_dedupe_plan(m, ["h"], F.col("n_chars"), F.col("h"), F.col("bound"), "doc_id")


@query("WITH " + _REMOTE.lstrip().lstrip(",") + "SELECT verdict, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra FROM g GROUP BY 1")
def remote_dedupe_totals(spark, d):
    return dedupe.remote_verdicts(*_remote(spark, d)).groupBy("verdict").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("extra"))


@query(with_views("messages", sql="SELECT folder, count(*) FILTER (subdir = 'cur') AS cur_count, count(*) FILTER (subdir = 'new') AS new_count, max(mtime) FILTER (subdir = 'cur') AS cur_mtime, max(mtime) FILTER (subdir = 'new') AS new_mtime FROM messages GROUP BY folder"))
def folder_checkpoint(spark, d):
    m = view(spark, d, "messages")
    of = lambda s, c: F.when(F.col("subdir") == s, F.col(c))
    return m.groupBy("folder").agg(F.count(of("cur", "mtime")).alias("cur_count"), F.count(of("new", "mtime")).alias("new_count"), F.max(of("cur", "mtime")).alias("cur_mtime"), F.max(of("new", "mtime")).alias("new_mtime"))


@query(with_views("messages", sql="""
    , now AS (SELECT folder, count(*) AS n, max(mtime) AS t FROM messages GROUP BY folder),
    old AS (SELECT folder, count(*) AS n, max(mtime) AS t FROM messages WHERE substr(folder, -1) <> '3' AND NOT (substr(folder, -1) = '7' AND doc_id % 10 = 4) GROUP BY folder)
    SELECT folder FROM now LEFT JOIN old USING (folder) WHERE old.n IS NULL OR old.n <> now.n OR old.t <> now.t
"""))
def dirty_folders(spark, d):
    m = view(spark, d, "messages")
    snap = lambda x: x.groupBy("folder").agg(F.struct(F.count("*").alias("n"), F.max("mtime").alias("t")).alias("s"))
    old = snap(m.filter(~F.col("folder").endswith("3") & ~(F.col("folder").endswith("7") & (F.col("doc_id") % 10 == 4)))).withColumnRenamed("s", "old")
    return snap(m).join(old, "folder", "left").filter(~F.col("s").eqNullSafe(F.col("old"))).select("folder")


@query(with_views("messages", sql="SELECT folder, bool_or(subdir IN ('cur', 'new')) AS is_maildir, bool_or(subdir = 'cur') AS ready FROM messages WHERE doc_id % 10 = 0 OR substr(folder, -1) <> '5' GROUP BY folder"))
def folder_presence(spark, d):
    m = view(spark, d, "messages").filter((F.col("doc_id") % 10 == 0) | ~F.col("folder").endswith("5"))
    return m.groupBy("folder").agg(F.bool_or(F.col("subdir").isin("cur", "new")).alias("is_maildir"), F.bool_or(F.col("subdir") == "cur").alias("ready"))


@query("SELECT event_id // 8 AS batch, bool_or(event_id % 3 = 0 OR event_id % 7 = 0) AS relevant, bool_or(event_id % 11 = 0) AS structural FROM events GROUP BY 1")
def batch_relevance(spark, d):
    e = F.col("event_id")
    ev = table(spark, d, "events").select(F.floor(e / 8).alias("batch"), F.when(e % 3 == 0, "cur").when(e % 11 == 0, "dir").otherwise("new").alias("sub"), (e % 7 != 0).alias("exists"), (e % 11 == 0).alias("trio"))
    relevant = (F.col("sub") == "cur") | ~F.col("exists")
    return ev.groupBy("batch").agg(F.bool_or(relevant).alias("relevant"), F.bool_or("trio").alias("structural"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'email_id' WHEN doc_id % 9 = 1 THEN 'blob_id' END AS dropped FROM documents")
def row_validation(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(k, F.when(k % 9 == 0, " ").otherwise("e").alias("email_id"), F.when(k % 9 == 1, "").otherwise("b").alias("blob_id"))
    fault = F.coalesce(*[F.when(F.trim(c) == "", F.lit(c)) for c in ("email_id", "blob_id")])
    return rows.select("doc_id", fault.alias("dropped"))


@query(with_views("messages", sql="""
    SELECT maildir_id, folder FROM messages WHERE doc_id % 4 = 0 AND maildir_id NOT IN (
        SELECT maildir_id FROM (SELECT maildir_id, row_number() OVER (PARTITION BY folder, message_id ORDER BY mtime, maildir_id) AS r FROM messages) WHERE r > 1)
"""))
def suppress_dedupe_victims(spark, d):
    m = view(spark, d, "messages")
    victims = dedupe.dedupe_plan(m).select("folder", "maildir_id")
    return m.filter("doc_id % 4 = 0").join(victims, ["folder", "maildir_id"], "left_anti").select("maildir_id", "folder")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS chunk FROM documents")
def batch_chunks(spark, d):
    rows = store.numbered(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")
    return rows.select("doc_id", F.floor(F.col("before") / 50).alias("chunk"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS slot FROM documents")
def round_robin(spark, d):
    return store.numbered(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id").select("doc_id", (F.col("before") % 5).alias("slot"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat(source, '/', doc_id))) AS r FROM documents) WHERE r <= 12")
def rebind_sample(spark, d):
    """Twelve messages of each folder by the order of a hash. A message goes on to the folder's sort only if it is among its task's first twelve."""
    h = F.sha2(F.concat_ws("/", "source", F.col("doc_id").cast("string")), 256)
    docs = table(spark, d, "documents").select("source", "doc_id", h.alias("h"))
    r = F.row_number().over(Window.partitionBy("source").orderBy("h"))
    return docs.withColumn("r", r).filter("r <= 12").select("source", "doc_id")


@query("SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 128")
def recent_n(spark, d):
    return table(spark, d, "events").orderBy(F.col("event_id").desc()).limit(128).select("event_id", "ts")


@query(with_views("cached", sql="SELECT mailbox_id, count(*) AS n, count(DISTINCT flags) AS kinds, bool_or(flags = '') AS any_plain FROM cached GROUP BY 1"))
def count_totals(spark, d):
    return view(spark, d, "cached").groupBy("mailbox_id").agg(F.count("*").alias("n"), F.countDistinct("flags").alias("kinds"), F.bool_or(F.col("flags") == "").alias("any_plain"))


@query(with_views("remote", sql="SELECT email_id, flags FROM remote WHERE mailbox_id = 'MB3'"))
def mailbox_members(spark, d):
    r = view(spark, d, "remote").withColumn("mailbox_ids", F.array("mailbox_id"))
    return r.filter(F.array_contains("mailbox_ids", "MB3")).select("email_id", "flags")


@query(with_views("remote", sql="SELECT email_id, mailbox_id, flags FROM remote WHERE email_id IN (SELECT concat('E', l_orderkey) FROM lineitem WHERE l_quantity > 45)"))
def get_by_ids(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("E"), F.col("l_orderkey").cast("string")).alias("email_id"))
    return view(spark, d, "remote").join(ids, "email_id", "left_semi").select("email_id", "mailbox_id", "flags")


_PAGES = """
    , changes AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS op, l_shipdate AS at FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01')
"""


@query("WITH " + _PAGES.lstrip().lstrip(",") + "SELECT id, min(op) AS first_op, max(op) = 2 AS destroyed FROM changes GROUP BY id")
def delta_collect(spark, d):
    """Ids of the change pages after a state, each once with its first kind (created, updated, destroyed)."""
    c = table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    op = F.when(F.col("l_linenumber") == 1, 0).when(F.col("l_linenumber") == 7, 2).otherwise(1)
    return c.groupBy(F.col("l_orderkey").alias("id")).agg(F.min(op).alias("first_op"), (F.max(op) == 2).alias("destroyed"))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem")
def initial_collect(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).dropDuplicates(["id"])


@query("SELECT user_id, bool_or(event_type = 'signup' OR event_type = 'error') AS structural FROM events GROUP BY user_id")
def structural_change_gate(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type").isin("signup", "error")).alias("structural"))


@query(with_views("cached", "remote", sql="SELECT email_id, mailbox_id, flags FROM remote UNION ALL SELECT email_id, mailbox_id, flags FROM cached WHERE email_id NOT IN (SELECT email_id FROM remote)"))
def upsert_merge(spark, d):
    """Rows of the cache that the server's don't replace, and the server's."""
    old, new = (view(spark, d, v).select("email_id", "mailbox_id", "flags") for v in ("cached", "remote"))
    return new.union(old.join(new, "email_id", "left_anti"))


@query(with_views("cached", sql="SELECT email_id, maildir_id FROM cached WHERE mailbox_id NOT IN ('MB1', 'MB7')"))
def cascade_delete(spark, d):
    c = view(spark, d, "cached")
    gone = c.filter(F.col("mailbox_id").isin("MB1", "MB7")).select("maildir_id").distinct()
    return c.join(gone, "maildir_id", "left_anti").select("email_id", "maildir_id")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey, n_name")
def lookup_mailboxes(spark, d):
    return table(spark, d, "nation").orderBy("n_regionkey", "n_name").select("n_nationkey", "n_name")


@query("SELECT CASE WHEN n_chars < 2048 THEN 'short' WHEN n_chars < 20480 THEN 'medium' ELSE 'long' END AS tier, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def size_tiers(spark, d):
    tier = F.when(F.col("n_chars") < 2048, "short").when(F.col("n_chars") < 20480, "medium").otherwise("long")
    return table(spark, d, "documents").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def chk_unique_binding(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_acctbal DESC, s_suppkey) AS try_order FROM supplier")
def srv_order(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_suppkey") % 3, F.col("s_acctbal").desc(), "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(w).cast("long").alias("try_order"))
