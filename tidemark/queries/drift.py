"""Queries of drift, pruning, orphans, rebinding and mailbox decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.registry import query
from tidemark.sources.tables import table, view, with_views

#: Folders of customers: on disk all but some, one in 11 renamed; known all but others; a sentinel in most.
_FOLDERS = """
    WITH disk AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN concat('new', c_custkey) ELSE c_name END AS folder, CASE WHEN c_custkey % 5 <> 0 THEN concat('C', c_custkey) END AS sentinel FROM customer WHERE c_custkey % 7 <> 0),
    known AS (SELECT c_name AS folder, concat('C', c_custkey) AS mailbox_id FROM customer WHERE c_custkey % 13 <> 0),
    selected AS (SELECT concat('C', c_custkey) AS mailbox_id, c_name AS folder FROM customer WHERE c_custkey % 17 <> 0),
    flying AS (SELECT d.folder AS new_name, k.folder AS old_name FROM disk d JOIN known k ON d.sentinel = k.mailbox_id WHERE d.folder <> k.folder),
    dropped AS (SELECT folder FROM known WHERE mailbox_id NOT IN (SELECT mailbox_id FROM selected) AND folder NOT IN (SELECT old_name FROM flying)),
    drift AS (SELECT new_name AS folder, 'rename_in_flight' AS class FROM flying UNION ALL SELECT old_name, 'rename_in_flight' FROM flying UNION ALL SELECT folder, 'config_dropped' FROM dropped
        UNION ALL SELECT folder, 'disk_only' FROM disk WHERE folder NOT IN (SELECT folder FROM known) AND folder NOT IN (SELECT new_name FROM flying)
        UNION ALL SELECT folder, 'db_only' FROM known WHERE folder NOT IN (SELECT folder FROM disk) AND folder NOT IN (SELECT old_name FROM flying) AND folder NOT IN (SELECT folder FROM dropped))
"""


def _folders(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    box = F.concat(F.lit("C"), k.cast("string"))
    disk = c.filter(k % 7 != 0).select(F.when(k % 11 == 0, F.concat(F.lit("new"), k.cast("string"))).otherwise(F.col("c_name")).alias("folder"), F.when(k % 5 != 0, box).alias("sentinel"))
    return disk, c.filter(k % 13 != 0).select(F.col("c_name").alias("folder"), box.alias("mailbox_id")), c.filter(k % 17 != 0).select(box.alias("mailbox_id"), F.col("c_name").alias("folder"))


@query(_FOLDERS + "SELECT folder, class FROM drift")
def drift_classes(spark, d):
    disk, known, selected = _folders(spark, d)
    return D.drift(disk, known, selected.select("mailbox_id"))


_PRUNE = _FOLDERS + """
    , files AS (SELECT concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS folder, o_orderkey FROM orders WHERE o_orderkey % 29 = 0),
    prune AS (SELECT folder, (SELECT count(*) FROM files f WHERE f.folder = d.folder) AS files, CASE WHEN folder IN (SELECT folder FROM selected) THEN 'needs force: configured'
              WHEN folder IN (SELECT folder FROM files) THEN 'needs force: not empty' ELSE 'safe' END AS label FROM drift d WHERE class IN ('disk_only', 'config_dropped'))
"""


def _prunable(spark, d):
    """Folders of the classes that can be removed, files in them, and folders that the configuration names."""
    disk, known, selected = _folders(spark, d)
    drifted = D.drift(disk, known, selected.select("mailbox_id")).filter(F.col("class").isin("disk_only", "config_dropped"))
    files = table(spark, d, "orders").filter("o_orderkey % 29 = 0").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("folder"), "o_orderkey")
    return drifted, files, selected


def _pruned(spark, d):
    return D.prune_plan(*_prunable(spark, d))


@query(_PRUNE + "SELECT folder, files, label FROM prune")
def prune_plan(spark, d):
    return _pruned(spark, d)


@query(_PRUNE + "SELECT folder, folder IN (SELECT folder FROM drift WHERE class = 'disk_only') AS disk_only, files, label FROM prune ORDER BY folder DESC")
def prune_narrow(spark, d):
    """Each side of a plan by itself, with files and labels: what is on disk alone, and the rest. Deepest folders first."""
    drifted, files, selected = _prunable(spark, d)
    sides = [D.prune_plan(D.narrowed(drifted, disk_only=on), files, selected).withColumn("disk_only", F.lit(on)) for on in (True, False)]
    return sides[0].union(sides[1]).select("folder", "disk_only", "files", "label").orderBy(F.col("folder").desc())


@query(_PRUNE + "SELECT label, count(*) AS n, bool_or(files > 0) AS any_files FROM prune GROUP BY label")
def prune_outcome(spark, d):
    return _pruned(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.bool_or(F.col("files") > 0).alias("any_files"))


@query(with_views("cached", "remote", sql="SELECT email_id, mailbox_id FROM cached WHERE email_id NOT IN (SELECT email_id FROM remote)"))
def orphans_local(spark, d):
    return view(spark, d, "cached").join(view(spark, d, "remote"), "email_id", "left_anti").select("email_id", "mailbox_id")


@query(with_views("cached", "remote", sql="SELECT mailbox_id, count(*) AS orphans, count(*) FILTER (flags <> '') AS flagged FROM cached WHERE email_id NOT IN (SELECT email_id FROM remote) GROUP BY 1"))
def orphan_totals(spark, d):
    return view(spark, d, "cached").join(view(spark, d, "remote"), "email_id", "left_anti").groupBy("mailbox_id").agg(F.count("*").alias("orphans"), F.count_if(F.col("flags") != "").alias("flagged"))


@query(_FOLDERS + "SELECT sentinel FROM disk WHERE sentinel IS NOT NULL AND sentinel NOT IN (SELECT mailbox_id FROM selected) AND sentinel NOT IN (SELECT mailbox_id FROM known)")
def orphans_sentinel(spark, d):
    disk, known, selected = _folders(spark, d)
    s = disk.filter("sentinel IS NOT NULL").select(F.col("sentinel").alias("mailbox_id"))
    return s.join(selected, "mailbox_id", "left_anti").join(known, "mailbox_id", "left_anti").select(F.col("mailbox_id").alias("sentinel"))


@query(_FOLDERS + "SELECT k.folder FROM known k WHERE k.folder NOT IN (SELECT folder FROM disk) AND k.mailbox_id NOT IN (SELECT sentinel FROM disk WHERE sentinel IS NOT NULL) AND k.mailbox_id IN (SELECT mailbox_id FROM selected)")
def orphans_remote(spark, d):
    """Known folders that are gone from the disk, whose sentinel is nowhere else and which are still bound."""
    disk, known, selected = _folders(spark, d)
    gone = known.join(disk, "folder", "left_anti").join(disk.filter("sentinel IS NOT NULL").select(F.col("sentinel").alias("mailbox_id")), "mailbox_id", "left_anti")
    return gone.join(selected, "mailbox_id", "left_semi").select("folder")


@query(with_views("local", "cached", sql="SELECT l.maildir_id, c.email_id FROM local l LEFT JOIN cached c USING (maildir_id) WHERE l.mailbox_id IN ('MB2', 'MB5')"))
def orphan_catalog(spark, d):
    files = view(spark, d, "local").filter(F.col("mailbox_id").isin("MB2", "MB5"))
    return files.join(view(spark, d, "cached").select("maildir_id", "email_id"), "maildir_id", "left").select("maildir_id", "email_id")


@query(with_views("local", "cached", sql="SELECT maildir_id FROM local WHERE maildir_id NOT IN (SELECT maildir_id FROM cached)"))
def rescue_unmapped(spark, d):
    return view(spark, d, "local").join(view(spark, d, "cached"), "maildir_id", "left_anti").select("maildir_id")


@query("""
    WITH s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE n_name END AS cached, CASE WHEN n_nationkey % 3 = 1 THEN concat(n_name, '2') ELSE n_name END AS server,
               CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey % 5 = 2 THEN concat(n_name, '3') WHEN n_nationkey % 5 = 4 AND n_nationkey % 3 = 1 THEN concat(n_name, '2') ELSE n_name END AS disk FROM nation)
    SELECT k, CASE WHEN cached IS NULL THEN 'first cycle' WHEN disk IS NULL OR disk = cached THEN CASE WHEN cached = server THEN 'unchanged' ELSE 'server rename' END
        WHEN disk = server THEN 'cache stale' WHEN cached = server THEN 'local rename' ELSE 'conflict: server wins' END AS decision FROM s
""")
def mailbox_decisions(spark, d):
    """What became of each mailbox's name, of the cached, the server's and the disk's."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    s = table(spark, d, "nation").select(
        k.alias("k"), F.when(k % 7 != 6, name).alias("c"), F.when(k % 3 == 1, F.concat(name, F.lit("2"))).otherwise(name).alias("s"),
        F.when(k % 4 != 3, F.when(k % 5 == 2, F.concat(name, F.lit("3"))).when((k % 5 == 4) & (k % 3 == 1), F.concat(name, F.lit("2"))).otherwise(name)).alias("d"),
    )
    c, v, disk = F.col("c"), F.col("s"), F.coalesce(F.col("d"), F.col("c"))
    decision = F.when(c.isNull(), "first cycle").when((c == v) & (disk == c), "unchanged").when(disk == c, "server rename").when(disk == v, "cache stale").when(c == v, "local rename").otherwise("conflict: server wins")
    return s.select("k", decision.alias("decision"))


_REBIND = """
    WITH member AS (SELECT DISTINCT l_orderkey AS message_id, l_suppkey % 6 AS mailbox_id FROM lineitem),
    sample AS (SELECT o_custkey % 40 AS folder, o_orderkey % 3 AS grp, o_orderkey AS s, o_orderkey AS message_id FROM orders WHERE o_orderkey % 500 < 12),
    hit AS (SELECT DISTINCT folder, grp, s, mailbox_id FROM sample JOIN member USING (message_id)),
    n AS (SELECT folder, grp, count(DISTINCT s) AS n FROM hit GROUP BY ALL),
    box AS (SELECT folder, grp, mailbox_id FROM (SELECT folder, grp, mailbox_id, count(DISTINCT s) AS k FROM hit GROUP BY ALL) JOIN n USING (folder, grp) WHERE k = n.n)
"""


def _groups(spark, d):
    member = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), (F.col("l_suppkey") % 6).alias("mailbox_id")).distinct()
    o = table(spark, d, "orders").filter("o_orderkey % 500 < 12")
    sample = o.select((F.col("o_custkey") % 40).alias("folder"), (F.col("o_orderkey") % 3).alias("group"), F.col("o_orderkey").alias("sample"), F.col("o_orderkey").alias("message_id"))
    return D.consensus(sample, member)


@query(_REBIND + "SELECT folder, grp, string_agg(CAST(mailbox_id AS VARCHAR), ',' ORDER BY mailbox_id) AS boxes FROM box GROUP BY ALL")
def rebind_intersect(spark, d):
    return _groups(spark, d).select("folder", F.col("group").alias("grp"), F.array_join("boxes", ",").alias("boxes"))


@query(_REBIND + """
    , g AS (SELECT folder, grp, count(*) AS n, min(mailbox_id) AS b FROM box GROUP BY ALL)
    SELECT folder, CASE WHEN min(n) = 1 AND max(n) = 1 AND min(b) = max(b) THEN min(b) END AS mailbox_id FROM g GROUP BY folder
""")
def rebind_consensus(spark, d):
    return D.decided(_groups(spark, d))


@query("SELECT n_regionkey AS region, count(*) FILTER (n_nationkey % 3 = 0 AND n_nationkey % 2 = 0) AS feasible FROM nation GROUP BY 1")
def rebind_feasibility(spark, d):
    """How many of a region's mailboxes are in the sets of both samples."""
    ids = lambda m: F.collect_set(F.when(F.col("n_nationkey") % m == 0, F.col("n_nationkey")))
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.size(F.array_intersect(ids(3), ids(2))).cast("long").alias("feasible"))


@query()
def rebind_matching(spark, d):
    """Folders of a region that can be bound in only one way. Not in SQL: a recursive search, held against permutations in the tests."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = n.select(F.col("n_regionkey").cast("long").alias("account"), name("f", k).alias("folder"), F.explode(F.array(name("m", k), F.when(k % 2 == 0, name("m", k + 5)).otherwise(name("m", k)))).alias("mailbox_id"))
    return D.unique_matchings(rows.distinct())


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('a=b', s_suppkey) ELSE concat('f', s_suppkey) END AS folder, concat('M', s_nationkey) AS mailbox, count(*) OVER (PARTITION BY s_nationkey) > 1 AS refused FROM supplier")
def bind_validation(spark, d):
    """Explicit binds folder=mailbox, split at the last =; a mailbox that is bound twice is refused."""
    s = F.col("s_suppkey")
    raw = F.concat(F.when(s % 3 == 0, "a=b").otherwise("f"), s.cast("string"), F.lit("=M"), F.col("s_nationkey").cast("string"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.regexp_extract(raw, "^(.*)=([^=]*)$", 1).alias("folder"), F.regexp_extract(raw, "^(.*)=([^=]*)$", 2).alias("mailbox"))
    return rows.join(rows.groupBy("mailbox").agg((F.count("*") > 1).alias("refused")), "mailbox").select("s_suppkey", "folder", "mailbox", "refused")


@query(_PRUNE + """
    , cut AS (SELECT folder FROM customer JOIN prune ON folder = c_name WHERE c_custkey % 2 = 0)
    SELECT folder, CASE WHEN label = 'needs force: configured' THEN 'skipped' WHEN folder IN (SELECT folder FROM cut) THEN 'deferred' ELSE 'removed' END AS outcome,
           label <> 'needs force: configured' AND folder NOT IN (SELECT folder FROM cut) AND folder IN (SELECT folder FROM known) AS unmapped FROM prune
""")
def prune_apply(spark, d):
    """What becomes of folders to prune when those with files may go, and some can't be removed just now."""
    blocked = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("folder"))
    return D.prune_outcome(_pruned(spark, d), _folders(spark, d)[1], blocked, force_non_empty=True)


@query(_PRUNE + "SELECT count(*) > 0 AS clear FROM prune WHERE label = 'safe' AND folder IN (SELECT folder FROM known)")
def prune_clears_cursor(spark, d):
    nothing = table(spark, d, "customer").filter("false").select(F.col("c_name").alias("folder"))
    return D.clears_cursor(D.prune_outcome(_pruned(spark, d), _folders(spark, d)[1], nothing))


@query(_FOLDERS + """
    , n AS (SELECT n_nationkey AS nation FROM nation), by_nation AS (SELECT c_nationkey AS nation, count(*) FILTER (c_custkey % 13 = 1) AS known FROM customer GROUP BY 1)
    SELECT nation, CASE WHEN nation % 6 = 0 THEN 'maildir_root_missing' WHEN coalesce(known, 0) = 0 THEN 'no_mailbox_map' END AS verdict FROM n LEFT JOIN by_nation USING (nation)
""")
def drift_verdicts(spark, d):
    """For each account, why there is no comparison: no root, or nothing known of any mailbox."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") % 6 != 0).alias("root"))
    known = table(spark, d, "customer").filter("c_custkey % 13 = 1").select(F.col("c_nationkey").alias("nation"))
    return D.verdicts(n, known, "nation")


@query(with_views("cached", "remote", sql="SELECT count(*) AS orphans, CAST(sum(n) AS BIGINT) AS server_emails FROM (SELECT mailbox_id, count(*) AS n FROM remote WHERE mailbox_id IN (SELECT mailbox_id FROM cached WHERE email_id NOT IN (SELECT email_id FROM remote)) GROUP BY 1)"))
def orphan_server_totals(spark, d):
    """Mailboxes with orphans, and how many mails the server has in them."""
    gone = view(spark, d, "cached").join(view(spark, d, "remote"), "email_id", "left_anti").select("mailbox_id").distinct()
    return view(spark, d, "remote").join(gone, "mailbox_id", "left_semi").groupBy("mailbox_id").agg(F.count("*").alias("server_email_count")).agg(F.count("*").alias("orphans"), F.sum("server_email_count").alias("server_emails"))


@query("""
    SELECT s_suppkey AS account, concat('f', i) AS folder, concat('m', i) AS mailbox_id FROM supplier, unnest(range(15)) t(i) WHERE s_suppkey % 4 = 0
""")
def rebind_cross_map(spark, d):
    """Folders whose samples leave several mailboxes open, given out where that goes in one way: a chain of 15 does (0 of 4), a ring doesn't (1), nor one with a folder too many (2) or without an ambiguous cause (3)."""
    a = F.col("account")
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("account"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"))
    m = lambda c: F.concat(F.lit("m"), c.cast("string"))
    i = F.col("i")
    folder = F.concat(F.lit("f"), i.cast("string")).alias("folder")
    other = F.when(a % 4 == 1, (i + 1) % 15).otherwise(F.least(i + 1, F.lit(14)))
    groups = base.select("account", folder, F.lit(0).alias("group"), F.array(m(i), m(other), F.lit("claimed")).alias("boxes")).union(base.select("account", folder, F.lit(1), F.array(m(i), m(other), F.lit("x")))).union(base.select("account", folder, F.lit(2), F.array().cast("array<string>")))
    skipped = base.select("account", folder, (~((a % 4 == 3) & (i == 7))).alias("ambiguous"))
    boxes = base.select("account", m(i).alias("mailbox_id"))
    disk = base.select("account", folder).union(base.filter((a % 4 == 2) & (i == 0)).select("account", F.lit("more")))
    return D.cross_mapping(groups, skipped, boxes, boxes.filter("false"), disk)


@query("""
    WITH b AS (SELECT CASE s_suppkey % 5 WHEN 0 THEN concat('../f', s_suppkey) WHEN 1 THEN concat('a/../f', s_suppkey) ELSE concat('f', s_suppkey) END AS folder, concat('Top/', CASE WHEN s_suppkey % 7 = 3 THEN 'x' ELSE '' END, s_suppkey - s_suppkey % 2) AS remote_path FROM supplier),
    s AS (SELECT concat('Top/', s_suppkey) AS remote_path, concat('M', s_suppkey) AS mailbox_id, s_suppkey FROM supplier),
    j AS (SELECT b.*, s.mailbox_id, s.s_suppkey % 11 = 0 AS claimed, count(s.mailbox_id) OVER (PARTITION BY s.mailbox_id) > 1 AS twice FROM b LEFT JOIN s USING (remote_path))
    SELECT folder, remote_path, mailbox_id, CASE WHEN folder LIKE '../%' THEN 'outside' WHEN folder NOT IN (SELECT concat('f', s_suppkey) FROM supplier WHERE s_suppkey % 3 <> 0) AND folder NOT LIKE 'a/%' THEN 'no folder'
        WHEN mailbox_id IS NULL THEN 'no mailbox' WHEN claimed OR twice THEN 'claimed' END AS refusal FROM j
""")
def bind_refusals(spark, d):
    """Explicit binds of folders to the server's paths, each with what is wrong with it."""
    k = F.col("s_suppkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    s = table(spark, d, "supplier")
    folder = F.when(k % 5 == 0, text("../f", k)).when(k % 5 == 1, text("a/../f", k)).otherwise(text("f", k))
    binds = s.select(folder.alias("folder"), F.concat(F.lit("Top/"), F.when(k % 7 == 3, "x").otherwise(""), (k - k % 2).cast("string")).alias("remote_path"))
    on_disk = s.filter(k % 3 != 0).select(text("f", k).alias("folder")).union(s.select(text("a/../f", k)))
    server = s.select(text("M", k).alias("mailbox_id"), text("Top/", k).alias("remote_path"))
    return D.refused_binds(binds, on_disk, server, s.filter(k % 11 == 0).select(text("M", k).alias("mailbox_id")))
