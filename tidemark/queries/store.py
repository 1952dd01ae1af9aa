"""Queries over the store's tables: sentinels, changes by key, references, state chains, numbering, path-driven scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators import store as T
from tidemark.registry import query
from tidemark.sources.shared import shared_dir
from tidemark.sources.tables import table, view, with_views


def _text(p, c, q=""):
    return F.concat(F.lit(p), c.cast("string"), F.lit(q))


def _sentinel_files(spark, d):
    k = F.col("doc_id")
    name = F.when(k % 11 == 0, "  ").when(k % 13 == 0, 'a\\"b\\\\c').otherwise(F.col("source"))
    text = F.concat(F.lit("# owner\n"), F.when(k % 7 == 0, "other = 1\n").otherwise(_text('mailbox_id = "M', k % 50, '"\n')), F.lit('name = "'), name, F.lit('"  # as on the server\n'), F.when(k % 3 == 0, _text('parent_id = "P', k % 5, '"')).otherwise(""))
    content = F.when(k % 17 == 0, F.concat(F.lit(bytearray(b"\xff")), F.encode(text, "utf-8"))).otherwise(F.encode(text, "utf-8"))
    return table(spark, d, "documents").select("doc_id", _text("F", k).alias("folder"), content.alias("content"))


_TRUSTED = "doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 17 <> 0"


@query(f"SELECT concat('F', doc_id) AS folder, concat('M', doc_id % 50) AS mailbox_id, CASE WHEN doc_id % 13 = 0 THEN 'a\"b\\c' ELSE source END AS name, CASE WHEN doc_id % 3 = 0 THEN concat('P', doc_id % 5) END AS parent_id FROM documents WHERE {_TRUSTED}")
def sentinels(spark, d):
    """Folders whose sentinel can be trusted; others have none."""
    return T.sentinels(_sentinel_files(spark, d))


@query(f"SELECT concat('M', doc_id % 50) AS mailbox_id, max(concat('F', doc_id)) AS folder FROM documents WHERE {_TRUSTED} GROUP BY 1")
def sentinel_map(spark, d):
    return T.sentinel_map(_sentinel_files(spark, d))


@query(with_views("cached", "remote", sql="SELECT c.email_id, c.mailbox_id, coalesce(r.flags, c.flags) AS flags FROM cached c LEFT JOIN remote r USING (email_id)"))
def update_by_key(spark, d):
    return T.update_by_key(view(spark, d, "cached").select("email_id", "mailbox_id", "flags"), view(spark, d, "remote").select("email_id", "flags"), "email_id")


@query("SELECT c_custkey, regexp_replace(concat(c_mktsegment, '/', c_nationkey), '^(BUILDING)(/|$)', 'HOUSES\\2') AS folder FROM customer")
def folder_rename(spark, d):
    return T.renamed_folder(table(spark, d, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("folder")), "BUILDING", "HOUSES")


@query(with_views("cached", sql="""
    SELECT 'message' AS kind, maildir_id AS key FROM cached WHERE mailbox_id NOT IN ('MB2', 'MB9') UNION ALL SELECT 'state', maildir_id FROM cached WHERE mailbox_id NOT IN ('MB2', 'MB9')
    UNION ALL SELECT DISTINCT 'checkpoint', mailbox_id FROM cached WHERE mailbox_id NOT IN ('MB2', 'MB9')
"""))
def cascade_three_tables(spark, d):
    c = view(spark, d, "cached")
    states = c.select("maildir_id", F.col("mailbox_id").alias("folder"))
    gone = spark.createDataFrame([("MB2",), ("MB9",)], "folder string")
    m, s, k = T.without_folders(gone, c.select("maildir_id"), states, states.select("folder").distinct())
    return m.select(F.lit("message").alias("kind"), F.col("maildir_id").alias("key")).union(s.select(F.lit("state"), "maildir_id")).union(k.select(F.lit("checkpoint"), "folder"))


@query(with_views("transfers", sql="SELECT direction, count(*) AS n FROM (SELECT * FROM transfers UNION ALL SELECT * FROM transfers WHERE bytes > 40) GROUP BY 1"))
def profile_append(spark, d):
    """Profile rows appended to a folder of JSON lines in two cycles, and read back."""
    rows = view(spark, d, "transfers").select("direction", "phase", "bytes")
    folder = f"{shared_dir(spark)}/profile-{uuid.uuid4().hex}"
    T.appended(rows, folder)
    return T.appended(rows.filter("bytes > 40"), folder).groupBy("direction").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (k NOT IN (0, 1, 4)) AS valid, count(*) FILTER (k IN (0, 1, 4)) AS dropped, CASE arg_min(k, doc_id) FILTER (k IN (0, 1, 4)) WHEN 0 THEN 'email_id' WHEN 1 THEN 'blob_id' WHEN 4 THEN 'thread_id' END AS first_fault FROM (SELECT *, doc_id % 9 AS k FROM documents) GROUP BY 1")
def row_validation_totals(spark, d):
    """How many rows of each folder lack an id, and what the first of them lacks."""
    k = F.col("doc_id") % 9
    blank = lambda n, v: F.when(k == n, v).otherwise("x")
    rows = table(spark, d, "documents").select("source", "doc_id", blank(0, " ").alias("email_id"), blank(1, "").alias("blob_id"), F.when(k != 4, "t").alias("thread_id"))
    return T.validated(rows, "doc_id", "email_id", "blob_id", "thread_id", by=("source",))[1]


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''), '|') AS members FROM documents")
def member_lists(spark, d):
    """What lists have once blanks are trimmed and empty members dropped."""
    return table(spark, d, "documents").select("doc_id", F.array_join(T.members(F.split("text", r"\.")), "|").alias("members"))


@query("""
    WITH RECURSIVE c AS (SELECT c_custkey AS ref, c_custkey // 4 AS parent FROM customer WHERE c_custkey % 7 <> 0),
    t AS (SELECT ref, parent, 0 AS depth FROM c WHERE parent IN (0, 7, 14, 21) UNION ALL SELECT c.ref, c.parent, t.depth + 1 FROM c JOIN t ON c.parent = t.ref)
    SELECT concat('#', ref) AS ref, concat('#', parent) AS parent_ref, CAST(depth AS INTEGER) AS depth FROM t
""")
def resolve_tree(spark, d):
    """Mailboxes to be made below others that are made in the same cycle, by depth; without those whose parent never is."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").filter(k % 7 != 0).select(_text("#", k).alias("ref"), _text("#", F.floor(k / 4)).alias("parent_ref"))
    return T.resolved_tree(rows, spark.createDataFrame([("#0",), ("#7",), ("#14",), ("#21",)], "ref string"))


@query("SELECT concat('m', doc_id, '@x') AS message_id, doc_id AS id FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT concat('m', doc_id - 1, '@x'), doc_id FROM documents WHERE (doc_id - 1) % 5 = 0 AND doc_id % 3 = 0")
def header_search(spark, d):
    """Wanted message ids in headers that hold several, or longer ones."""
    k = F.col("doc_id")
    header = F.concat(_text("<m", k, "@x>"), _text(" <m", k, "y@x> m5@x"), F.when(k % 3 == 0, _text(" < m", k - 1, "@x >")).otherwise(""))
    wanted = table(spark, d, "documents").select(F.explode(F.array(k - 1, k)).alias("k")).filter("k % 5 = 0").select(_text("m", F.col("k"), "@x").alias("message_id"))
    return T.found_by_header(table(spark, d, "documents").select(k.alias("id"), header.alias("header")), wanted)


@query("""
    WITH n AS (SELECT conv_id, max(turn) AS last, min(turn) AS first FROM conversations GROUP BY 1)
    SELECT conv_id AS account, md5(concat(conv_id, '/', first)) AS cursor,
           CASE WHEN conv_id % 13 = 3 THEN NULL WHEN conv_id % 11 = 2 OR conv_id % 7 = 1 OR conv_id % 9 = 4 OR conv_id % 10 = 6 AND last > first THEN md5(concat(conv_id, '/', first)) ELSE md5(concat(conv_id, '/', last + 1)) END AS advanced
    FROM n
""")
def cursor_walk(spark, d):
    """Cursors along edges of opaque states: held after an incomplete pull (3 of 13), left alone with a broken half (2 of 11), a ring (1 of 7), a loop elsewhere (4 of 9) or a gap (6 of 10)."""
    state = lambda t: F.md5(F.concat(F.col("account").cast("string"), F.lit("/"), t.cast("string")))
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("account"), "turn").agg(F.lit(0).alias("x"))
    ends = c.groupBy("account").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    a = F.col("account")
    edges = c.join(ends, "account").filter(~((a % 10 == 6) & (F.col("turn") == F.col("last")) & (F.col("last") > F.col("first")))).select("account", state(F.col("turn")).alias("old"), state(F.col("turn") + 1).alias("new"))
    edges = edges.union(ends.filter(a % 7 == 1).select("account", state(F.col("last") + 1), state(F.col("first")))).union(ends.filter(a % 9 == 4).select("account", F.lit("s"), F.lit("s")))
    edges = edges.union(ends.filter((a % 10 == 6) & (F.col("last") > F.col("first"))).select("account", F.lit("p"), F.lit("q"))).withColumn("seq", F.lit(0))
    cursors = ends.select("account", state(F.col("first")).alias("cursor"), (a % 11 != 2).alias("intact"), (a % 13 == 3).alias("incomplete"))
    return T.walked(cursors, edges)


@query("""
    SELECT source AS folder, CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 8 WHEN 2 THEN 'deleted' WHEN 4 THEN 'new' WHEN 6 THEN 'flags' ELSE 'same' END AS kind,
           CASE WHEN doc_id % 8 <> 2 THEN CASE WHEN doc_id % 16 = 0 THEN 'new' ELSE 'cur' END END AS subdir
    FROM documents WHERE doc_id % 2 = 0
""")
def scan_paths_diff(spark, d):
    """Messages that events name: a file in cur goes before one in new, a missing file is deleted only where the cache has it in that folder."""
    k = F.col("doc_id")
    base = table(spark, d, "documents").select("doc_id", F.col("source").alias("folder"), k.cast("string").alias("id"))
    named = base.filter(k % 2 == 0).union(base.filter(k % 2 == 0)).select("folder", "id")
    elsewhere = base.filter(k % 8 == 2).select(F.concat("folder", F.lit("x")).alias("folder"), "id")
    files = base.filter(k % 8 != 2).select("folder", "id", F.when(k % 16 == 0, "new").otherwise("cur").alias("subdir"), F.when(k % 8 == 6, "S").otherwise("").alias("flags"))
    files = files.union(base.filter(k % 16 == 8).select("folder", "id", F.lit("new"), F.lit("F")))
    known = base.filter(k % 8 != 4).select("folder", "id", F.lit("").alias("flags"))
    return T.scanned(named.union(elsewhere), files, known).select("folder", "id", "kind", "subdir")


@query("SELECT DISTINCT concat('f', o_custkey) AS folder FROM orders WHERE o_custkey % 3 = 0 OR o_custkey % 5 = 1")
def scan_folders(spark, d):
    f = table(spark, d, "orders").select("o_custkey", _text("f", F.col("o_custkey")).alias("folder"))
    return T.scan_set(f.filter("o_custkey % 3 = 0"), f.filter("o_custkey % 5 = 1"), True)


@query(with_views("tree", sql="SELECT id AS mailbox_id, name AS folder, parent_id, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS unread FROM tree"))
def rebuilt_mailboxes(spark, d):
    return T.rebuilt(view(spark, d, "tree").withColumnsRenamed({"id": "mailbox_id", "name": "folder"}))


@query("""
    WITH c AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 7 THEN 2 ELSE 1 END AS op, l_orderkey * 8 + l_linenumber AS seq FROM lineitem WHERE l_quantity > 30),
    f AS (SELECT id, min({'op': op, 'seq': seq}) AS f FROM c GROUP BY 1)
    SELECT id, row_number() OVER (ORDER BY f.op, f.seq) - 1 AS place FROM f
""")
def delta_order(spark, d):
    """Ids of change pages in the order of first sight: created before updated before destroyed."""
    n = F.col("l_linenumber")
    op = F.when(n == 1, 0).when(n == 7, 2).otherwise(1)
    first = table(spark, d, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.struct(op.alias("op"), (F.col("l_orderkey") * 8 + n).alias("seq"))).alias("f"))
    most = first.agg(F.max("f.seq")).first()[0] or 0
    rows = first.select("id", F.lit("all").alias("g"), (F.col("f.op") * (most + 1) + F.col("f.seq")).alias("at"))
    return T.numbered(rows, "g", "at", name="place").select("id", "place")


@query("SELECT doc_id AS probe, doc_id FROM documents WHERE n_chars > 0")
def row_at_offset(spark, d):
    """The document of a folder that an offset falls into: the last one that starts at or before it."""
    docs = table(spark, d, "documents")
    o = T.numbered(docs.select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), "start").filter("n_chars > 0")
    probes = o.select("source", F.col("doc_id").alias("probe"), (F.col("start") + F.floor(F.col("n_chars") / 2)).alias("pos"))
    return ordered.containing(o.select("source", "doc_id", "start"), probes, "source").select("probe", "doc_id")
