"""Queries of the reconciliation plan and its parts.

The SQL finds each order's fate from how the views were derived from its key's last digit, and from the
views alone where moves are concerned; it doesn't follow the stages of the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import folders as D
from tidemark.operators import orphans as O
from tidemark.operators import reconcile as R
from tidemark.registry import query
from tidemark.sources.tables import VIEWS, table, view, with_views


def _sides(spark, d, winner: str = "server") -> R.Sides:
    return R.Sides(*(view(spark, d, n) for n in ("remote", "cached", "local")), R.Policy(winner))


#: What the parts share: files that came, files that went, and pairs of both for one message.
_BASE = """
    , came AS (SELECT l.* FROM local l LEFT JOIN cached c USING (maildir_id) WHERE c.maildir_id IS NULL OR c.mailbox_id <> l.mailbox_id),
    went AS (SELECT c.* FROM cached c WHERE maildir_id NOT IN (SELECT maildir_id FROM local)),
    reflag AS (SELECT c.email_id, l.maildir_id, l.flags FROM local l JOIN cached c USING (maildir_id) WHERE c.mailbox_id = l.mailbox_id AND c.flags <> l.flags),
    dead AS (SELECT * FROM cached WHERE email_id NOT IN (SELECT email_id FROM remote)),
    moved AS (SELECT w.email_id, n.maildir_id, w.mailbox_id AS from_box, n.mailbox_id AS to_box, w.flags AS old_flags, n.flags
              FROM went w JOIN came n USING (message_id) WHERE w.mailbox_id <> n.mailbox_id AND w.email_id NOT IN (SELECT email_id FROM dead)),
    pair AS (SELECT r.email_id, r.mailbox_id, r.flags, c.mailbox_id AS old_box, c.maildir_id, c.flags AS old_flags FROM remote r JOIN cached c USING (email_id)),
    again AS (SELECT c.email_id, n.maildir_id, n.mailbox_id, c.flags, n.flags AS file_flags FROM came n JOIN (SELECT email_id, message_id, mailbox_id, flags FROM cached) c USING (message_id, mailbox_id) WHERE n.maildir_id NOT IN (SELECT maildir_id FROM moved)),
    clash AS (SELECT * FROM pair WHERE (flags <> old_flags OR mailbox_id <> old_box) AND email_id IN (SELECT email_id FROM went) AND email_id NOT IN (SELECT email_id FROM moved) AND email_id NOT IN (SELECT email_id FROM again))
"""
_PARTS = {
    "download": "SELECT email_id, NULL AS maildir_id, NULL AS source, mailbox_id AS target, flags FROM remote WHERE email_id NOT IN (SELECT email_id FROM cached) AND email_id NOT IN (SELECT email_id FROM adopted) UNION ALL SELECT email_id, NULL, NULL, mailbox_id, flags FROM clash",
    "move_local": "SELECT email_id, maildir_id, old_box AS source, mailbox_id AS target, NULL AS flags FROM pair WHERE mailbox_id <> old_box AND email_id NOT IN (SELECT email_id FROM went)",
    "update_local_flags": "SELECT email_id, maildir_id, NULL AS source, NULL AS target, flags FROM pair WHERE flags <> old_flags AND email_id NOT IN (SELECT email_id FROM went) UNION ALL SELECT email_id, maildir_id, NULL, NULL, flags FROM again WHERE flags <> file_flags",
    "update_remote_flags": "SELECT email_id, maildir_id, NULL AS source, NULL AS target, flags FROM reflag WHERE email_id NOT IN (SELECT email_id FROM dead) AND email_id NOT IN (SELECT email_id FROM pair WHERE flags <> old_flags) UNION ALL SELECT email_id, maildir_id, NULL, NULL, flags FROM moved WHERE flags <> old_flags",
    "delete_local": "SELECT email_id, maildir_id, mailbox_id AS source, NULL AS target, NULL AS flags FROM dead WHERE maildir_id NOT IN (SELECT maildir_id FROM went)",
    "upload": "SELECT NULL AS email_id, maildir_id, NULL AS source, mailbox_id AS target, flags FROM came WHERE maildir_id NOT IN (SELECT maildir_id FROM moved) AND maildir_id NOT IN (SELECT maildir_id FROM adopted) AND message_id NOT IN (SELECT message_id FROM cached)",
    "destroy_remote": "SELECT email_id, maildir_id, mailbox_id AS source, NULL AS target, NULL AS flags FROM went WHERE email_id NOT IN (SELECT email_id FROM dead) AND email_id NOT IN (SELECT email_id FROM clash) AND email_id NOT IN (SELECT email_id FROM moved) AND email_id NOT IN (SELECT email_id FROM again)",
    "move_remote": "SELECT email_id, maildir_id, from_box AS source, to_box AS target, NULL AS flags FROM moved",
    "adopt_moved": "SELECT email_id, maildir_id, NULL AS source, to_box AS target, NULL AS flags FROM moved",
    "adopt": "SELECT email_id, maildir_id, NULL AS source, mailbox_id AS target, NULL AS flags FROM adopted UNION ALL SELECT email_id, maildir_id, NULL, mailbox_id, NULL FROM again",
}
_ADOPTED = ", adopted AS (SELECT r.email_id, n.maildir_id, n.mailbox_id FROM remote r JOIN came n USING (message_id, mailbox_id) WHERE r.email_id NOT IN (SELECT email_id FROM cached) AND n.maildir_id NOT IN (SELECT maildir_id FROM moved))"


def _sql(tail: str) -> str:
    return with_views("remote", "cached", "local", sql=_BASE + _ADOPTED + tail)


def _part(kind: str) -> str:
    return f"SELECT CAST({R.PHASES[kind]} AS INTEGER) AS phase, '{kind.removesuffix("_moved")}' AS kind, CAST(email_id AS VARCHAR) AS email_id, maildir_id, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, CAST(flags AS VARCHAR) AS flags FROM ({_PARTS[kind]})"


_PLAN = ", plan AS (" + " UNION ALL ".join(map(_part, _PARTS)) + ") "


@query(_sql("SELECT email_id, maildir_id, from_box, to_box, old_flags, flags FROM moved"))
def recon_moves(spark, d):
    return _sides(spark, d).moves()


@query(_sql(_part("download")))
def recon_download(spark, d):
    return _sides(spark, d).downloads()


@query(_sql(_part("update_local_flags")))
def recon_local_flag_update(spark, d):
    return _sides(spark, d).local_flag_updates()


@query(_sql(_part("move_local")))
def recon_move_local(spark, d):
    return _sides(spark, d).local_moves()


@query(_sql(", p AS (" + _part("move_local") + ") SELECT * FROM p WHERE source NOT IN ('MB3', 'MB5') AND target NOT IN ('MB3', 'MB5')"))
def recon_move_local_live(spark, d):
    """Moves among mailboxes that take part; two don't."""
    s = _sides(spark, d)
    live = s.remote.select("mailbox_id").union(s.cached.select("mailbox_id")).distinct().filter(~F.col("mailbox_id").isin("MB3", "MB5"))
    return R.Sides(s.remote, s.cached, s.local, s.policy, live).local_moves()


@query(_sql(_part("delete_local")))
def recon_delete_local(spark, d):
    return _sides(spark, d).local_deletes()


@query(_sql(_part("upload")))
def recon_local_new(spark, d):
    return _sides(spark, d).uploads()


@query(_sql(_part("update_remote_flags")))
def recon_local_flags(spark, d):
    return _sides(spark, d).remote_flag_updates()


@query(_sql(_part("destroy_remote")))
def recon_destroy_remote(spark, d):
    return _sides(spark, d).remote_destroys()


@query(_sql("SELECT email_id, mailbox_id, flags, old_box, maildir_id, old_flags FROM clash"))
def recon_delete_conflict(spark, d):
    return _sides(spark, d).delete_conflicts().select("email_id", "mailbox_id", "flags", "old_box", "maildir_id", "old_flags")


@query(_sql("SELECT r.email_id, r.flags AS server, c.flags AS old, p.flags AS local FROM remote r JOIN cached c USING (email_id) JOIN reflag p USING (email_id) WHERE r.flags <> c.flags"))
def recon_flag_conflict(spark, d):
    """Messages whose flags both sides changed."""
    s = _sides(spark, d)
    both = s.server_flags.select("email_id", F.col("flags").alias("server"), F.col("old_flags").alias("old"))
    return both.join(s.flagged.select("email_id", F.col("new_flags").alias("local")), "email_id")


@query(_sql("SELECT CASE WHEN c.email_id IS NULL THEN 'unknown' ELSE 'known' END AS side, count(*) AS n FROM remote r LEFT JOIN cached c USING (email_id) GROUP BY 1"))
def recon_known_split(spark, d):
    s = _sides(spark, d)
    return s.known.select(F.lit("known").alias("side")).union(s.unknown.select(F.lit("unknown"))).groupBy("side").agg(F.count("*").alias("n"))


@query(_sql("""
    SELECT 'new' AS kind, maildir_id, message_id, mailbox_id, NULL AS old_flags, flags AS new_flags, size FROM came
    UNION ALL SELECT 'flags', maildir_id, message_id, mailbox_id, c.flags, l.flags, size FROM local l JOIN (SELECT maildir_id, mailbox_id, flags FROM cached) c USING (maildir_id, mailbox_id) WHERE c.flags <> l.flags
    UNION ALL SELECT 'deleted', maildir_id, message_id, mailbox_id, flags, NULL, NULL FROM went
"""))
def classify_changes(spark, d):
    return _sides(spark, d).changes


@query(_sql(_PLAN + "SELECT * FROM plan"))
def recon_plan(spark, d):
    return _sides(spark, d).plan()


@query(_sql(_PLAN + "SELECT kind, count(*) AS n FROM plan GROUP BY kind"))
def plan_summary(spark, d):
    return _sides(spark, d).plan().groupBy("kind").agg(F.count("*").alias("n"))


@query(_sql(_PLAN + "SELECT " + ", ".join(f"count(*) FILTER (kind IN ({', '.join(map(repr, kinds))})) AS {name}" for name, kinds in R.COUNTERS.items()) + ", count(*) = 0 AS empty FROM plan"))
def plan_counters(spark, d):
    """What a plan's summary says."""
    return R.summary(_sides(spark, d).plan())


@query(_sql(_PLAN + """
    SELECT phase, email_id, maildir_id, concat_ws(' ', CASE WHEN kind IN ('move_remote', 'upload', 'update_remote_flags', 'destroy_remote') THEN 'push' ELSE 'pull' END, replace(kind, '_', ' '), coalesce(email_id, maildir_id, 'folder'),
        CASE WHEN source IS NOT NULL THEN concat('from ', source) END, CASE WHEN target IS NOT NULL THEN concat('to ', target) END) AS line FROM plan
"""))
def plan_lines(spark, d):
    """A plan in words."""
    return R.described(_sides(spark, d).plan())


@query(_sql(_PLAN + "SELECT kind, count(*) AS n FROM plan WHERE kind IN ('adopt', 'move_remote', 'upload', 'update_remote_flags', 'destroy_remote') GROUP BY kind"))
def plan_filter_direction(spark, d):
    return R.keep_direction(_sides(spark, d).plan(), "push").groupBy("kind").agg(F.count("*").alias("n"))


@query(_sql(_PLAN + "SELECT phase, email_id, maildir_id, kind FROM plan ORDER BY phase, email_id NULLS FIRST, maildir_id NULLS FIRST"))
def plan_phase_order(spark, d):
    """All actions in the order in which they are carried out."""
    return _sides(spark, d).plan().orderBy("phase", "email_id", "maildir_id").select("phase", "email_id", "maildir_id", "kind")


@query(_sql(_PLAN + "SELECT phase, kind, email_id, maildir_id, kind IN ('adopt', 'download', 'update_local_flags', 'move_local', 'delete_local') AS kept FROM plan"))
def plan_direction_split(spark, d):
    """Both halves of a plan in a run that only pulls."""
    return R.with_direction(_sides(spark, d).plan(), "pull").select("phase", "kind", "email_id", "maildir_id", "kept")


@query(_sql(_PLAN + "SELECT CAST(count(*) FILTER (contains(kind, 'flags')) AS BIGINT) AS flags, count(*) FILTER (contains(kind, 'move')) AS moves, count(*) FILTER (kind IN ('delete_local', 'destroy_remote')) AS deletes FROM plan"))
def cycle_outcome(spark, d):
    k = F.col("kind")
    return _sides(spark, d).plan().agg(F.count_if(k.contains("flags")).alias("flags"), F.count_if(k.contains("move")).alias("moves"), F.count_if(k.isin("delete_local", "destroy_remote")).alias("deletes"))


@query(_sql(_PLAN + """
    , gone AS (SELECT email_id FROM plan WHERE kind IN ('delete_local', 'destroy_remote')),
    every AS (SELECT email_id FROM cached UNION SELECT email_id FROM plan WHERE kind IN ('download', 'adopt'))
    SELECT e.email_id, coalesce((SELECT max(target) FROM plan p WHERE p.email_id = e.email_id AND kind IN ('move_local', 'move_remote', 'adopt', 'download')), c.mailbox_id) AS mailbox_id,
           coalesce((SELECT max(maildir_id) FROM plan p WHERE p.email_id = e.email_id AND kind = 'adopt'), c.maildir_id) AS maildir_id,
           coalesce((SELECT max(flags) FROM plan p WHERE p.email_id = e.email_id AND kind IN ('update_local_flags', 'update_remote_flags', 'download')), c.flags) AS flags
    FROM every e LEFT JOIN cached c USING (email_id) WHERE e.email_id NOT IN (SELECT email_id FROM gone)
"""))
def apply_plan_state(spark, d):
    s = _sides(spark, d)
    return R.applied(s.cached, s.plan())


@query(_sql(_PLAN + "SELECT email_id, maildir_id FROM plan WHERE kind = 'adopt' AND email_id NOT IN (SELECT email_id FROM cached WHERE substr(email_id, -2, 1) = '1')"))
def move_adopt_apply(spark, d):
    """Adoptions after the remote batch, without those whose update failed there."""
    s = _sides(spark, d)
    failed = s.cached.filter(F.substring("email_id", -2, 1) == "1").select("email_id")
    return s.plan().filter("kind = 'adopt'").join(failed, "email_id", "left_anti").select("email_id", "maildir_id")


_ORPHANS = " , orphans AS (SELECT mailbox_id FROM (VALUES ('MB1'), ('MB4'), ('MB99')) t(mailbox_id)) "
_ROLES = _PLAN + _ORPHANS + """
    , home AS (SELECT p.*, c.mailbox_id AS home FROM plan p LEFT JOIN cached c ON p.email_id = c.email_id),
    role AS (SELECT *, CASE WHEN (kind IN ('upload', 'move_remote') OR phase = 16) AND target IN (SELECT * FROM orphans) THEN 'in' WHEN home IN (SELECT * FROM orphans) AND kind = 'update_remote_flags' THEN 'changed'
             WHEN home IN (SELECT * FROM orphans) AND kind IN ('move_remote', 'destroy_remote') THEN 'moot' END AS role FROM home)
"""


def _orphans(spark):
    return spark.createDataFrame([("MB1",), ("MB4",), ("MB99",)], "mailbox_id string")


@query(_sql(_ROLES + """
    SELECT kind, email_id, maildir_id, source, target FROM role WHERE role IS NULL UNION ALL SELECT 'move_local', email_id, maildir_id, target, source FROM role WHERE role = 'in' AND kind = 'move_remote' AND source NOT IN (SELECT * FROM orphans)
    UNION ALL SELECT 'delete_local_folder', NULL, NULL, mailbox_id, NULL FROM orphans
"""))
def orphan_matrix_local(spark, d):
    s = _sides(spark, d)
    return O.settle_local(s.plan(), s.cached, _orphans(spark), "server").drop("phase")


@query(_sql(_ROLES + """
    , blocked AS (SELECT DISTINCT CASE WHEN role = 'in' THEN target ELSE home END AS mailbox_id FROM role WHERE role IN ('in', 'changed'))
    SELECT kind, email_id, maildir_id, source, target FROM role WHERE role IS NULL UNION ALL SELECT 'create_remote_mailbox', NULL, NULL, NULL, mailbox_id FROM blocked
    UNION ALL SELECT 'upload', NULL, maildir_id, NULL, mailbox_id FROM local WHERE size <= 200000 AND mailbox_id IN (SELECT * FROM blocked)
    UNION ALL SELECT 'delete_local_folder', NULL, NULL, mailbox_id, NULL FROM orphans WHERE mailbox_id NOT IN (SELECT * FROM blocked)
"""))
def orphan_matrix_local_wins(spark, d):
    """The same where the local side wins: mailboxes with something that keeps them are made anew, with the files in their folders."""
    s = _sides(spark, d)
    return O.settle_local(s.plan(), s.cached, _orphans(spark), "local", s.local, 200000).drop("phase")


@query(_sql(_PLAN + _ORPHANS + """
    SELECT kind, email_id, maildir_id, source, target FROM plan WHERE target IS NULL OR target NOT IN (SELECT * FROM orphans)
    UNION ALL SELECT 'move_remote', email_id, maildir_id, target, source FROM plan WHERE kind = 'move_local' AND target IN (SELECT * FROM orphans) AND source NOT IN (SELECT * FROM orphans)
    UNION ALL SELECT 'destroy_remote_mailbox', NULL, NULL, mailbox_id, NULL FROM orphans
"""))
def orphan_matrix_remote(spark, d):
    return O.settle_remote(_sides(spark, d).plan(), _orphans(spark)).drop("phase")


@query(_sql(_ORPHANS + "SELECT 'create_remote_mailbox' AS kind, mailbox_id, NULL AS maildir_id FROM orphans UNION ALL SELECT 'upload', mailbox_id, maildir_id FROM local WHERE size <= 200000 AND mailbox_id IN (SELECT * FROM orphans)"))
def orphan_resurrect(spark, d):
    return O.resurrected(_orphans(spark), view(spark, d, "local"), 200000)


@query(_sql(_ORPHANS + "SELECT mailbox_id, mailbox_id IN (SELECT mailbox_id FROM remote) AS live FROM orphans"))
def orphan_resurrect_prepass(spark, d):
    return O.hoisted(_orphans(spark), view(spark, d, "remote"))


@query(_sql(_PLAN + _ORPHANS + """
    , delta AS (SELECT * FROM remote WHERE size % 50 = 0 AND mailbox_id <> 'MB4'), live AS (SELECT mailbox_id FROM orphans WHERE mailbox_id IN (SELECT mailbox_id FROM delta)), mails AS (SELECT * FROM remote WHERE mailbox_id IN (SELECT * FROM live))
    SELECT phase, kind, email_id, maildir_id, source, target FROM plan WHERE NOT coalesce(kind = 'destroy_remote' AND email_id IN (SELECT email_id FROM cached WHERE mailbox_id IN (SELECT * FROM live)) OR kind = 'download' AND email_id IN (SELECT email_id FROM mails), FALSE)
    UNION ALL SELECT 1, 'create_local_mailbox', NULL, NULL, NULL, mailbox_id FROM live UNION ALL SELECT 4, 'download', email_id, NULL, NULL, mailbox_id FROM mails
"""))
def orphan_hoisted(spark, d):
    """A plan in which mailboxes of deleted folders are live again where the server changed something in them: they come back whole."""
    s = _sides(spark, d)
    return O.hoist(s.plan(), s.cached, _orphans(spark), s.remote.filter("size % 50 = 0 AND mailbox_id <> 'MB4'"), s.remote)[0]


@query(_sql("SELECT email_id, min(box) AS mailbox_id FROM (SELECT email_id, mailbox_id AS box FROM remote UNION ALL SELECT email_id, concat('MB', size % 25) FROM remote) WHERE box NOT IN ('MB3', 'MB5') AND CAST(substr(box, 3) AS INTEGER) < 20 GROUP BY 1"))
def recon_membership(spark, d):
    """The smallest live mailbox of mails that are in several."""
    r = view(spark, d, "remote").select("email_id", F.explode(F.array("mailbox_id", F.concat(F.lit("MB"), (F.col("size") % 25).cast("string")))).alias("mailbox_id"))
    live = view(spark, d, "cached").select("mailbox_id").distinct().filter(~F.col("mailbox_id").isin("MB3", "MB5"))
    return r.join(live, "mailbox_id", "left_semi").groupBy("email_id").agg(F.min("mailbox_id").alias("mailbox_id"))


@query(_sql("""
    SELECT r.email_id, CASE WHEN r.size % 11 = 0 THEN 'destroyed' WHEN r.mailbox_id IN ('MB3', 'MB5') THEN 'not synced' WHEN c.email_id IS NULL AND r.size % 3 = 0 THEN 'no message id' END AS reason
    FROM remote r LEFT JOIN cached c USING (email_id) WHERE r.size % 11 = 0 OR r.mailbox_id IN ('MB3', 'MB5') OR c.email_id IS NULL AND r.size % 3 = 0
"""))
def recon_skips(spark, d):
    """Mails that take no part, and why."""
    r = view(spark, d, "remote").withColumn("anchor", F.when(F.col("size") % 3 != 0, F.col("message_id")))
    gone = r.filter("size % 11 = 0").select("email_id", F.lit(True).alias("gone"))
    known = view(spark, d, "cached").select("email_id", F.lit(True).alias("known"))
    r = r.join(gone, "email_id", "left").join(known, "email_id", "left")
    reason = F.when(F.col("gone"), "destroyed").when(F.col("mailbox_id").isin("MB3", "MB5"), "not synced").when(F.col("known").isNull() & F.col("anchor").isNull(), "no message id")
    return r.select("email_id", reason.alias("reason")).filter("reason IS NOT NULL")


_AGAIN = ", fresh AS (SELECT email_id || 'b' AS email_id, message_id, mailbox_id, flags, email_id AS twin FROM remote WHERE size % 4 = 0 UNION ALL SELECT email_id || 'b', message_id, mailbox_id, flags, email_id FROM cached WHERE email_id IN (SELECT email_id FROM dead)) "


def _fresh(spark, d):
    """Mails with new ids for messages that the cache knows under others."""
    s = _sides(spark, d)
    pick = lambda df: df.select(F.concat("email_id", F.lit("b")).alias("email_id"), "message_id", "mailbox_id", "flags")
    return s, pick(s.remote.filter("size % 4 = 0")).union(pick(s.destroyed))


@query(_sql(_AGAIN + "SELECT f.email_id, c.maildir_id, CASE WHEN c.email_id IN (SELECT email_id FROM dead) THEN 'rebind' ELSE 'skip: still alive' END AS verdict FROM fresh f JOIN cached c USING (message_id, mailbox_id)"))
def recon_adopt_db(spark, d):
    s, fresh = _fresh(spark, d)
    return R.rebind_verdicts(fresh, s.cached, s.destroyed)


@query(_sql(_AGAIN + "SELECT f.email_id, l.maildir_id, row_number() OVER (PARTITION BY l.maildir_id ORDER BY f.email_id) > 1 AS refused FROM (SELECT * FROM fresh UNION ALL SELECT email_id || 'c', message_id, mailbox_id, flags, twin FROM fresh) f JOIN local l USING (message_id, mailbox_id)"))
def recon_adopt_disk(spark, d):
    """Files that mails of the server claim; of several mails for one file the first has it."""
    s, fresh = _fresh(spark, d)
    both = fresh.union(fresh.withColumn("email_id", F.concat("email_id", F.lit("c"))))
    return R.claims(both, s.local)


@query(_sql(_AGAIN + """
    , unlike AS (SELECT f.email_id, f.flags AS server, l.flags AS file, substr(f.email_id, -3, 1) IN ('0', '4') AS bare FROM fresh f JOIN local l USING (message_id, mailbox_id) WHERE f.flags <> l.flags)
    SELECT 'server' AS winner, email_id, 'update_local_flags' AS action, server AS flags, NULL AS patch FROM unlike WHERE NOT bare
    UNION ALL SELECT 'local', email_id, 'update_remote_flags', file, concat('{"$draft":', contains(file, 'D'), ',"$flagged":', contains(file, 'F'), ',"$forwarded":', contains(file, 'P'), ',"$answered":', contains(file, 'R'), ',"$seen":', contains(file, 'S'), ',"$deleted":', contains(file, 'T'), '}') FROM unlike
"""))
def recon_adopt_flags(spark, d):
    """What brings the flags of adopted files and of their messages together, whoever wins; some messages lack their other ids."""
    s, fresh = _fresh(spark, d)
    blob = F.when(~F.substring("email_id", -3, 1).isin("0", "4"), "b").alias("blob_id")
    files = s.local.select("message_id", "mailbox_id", F.col("flags").alias("file_flags"))
    rows = fresh.join(files, ["message_id", "mailbox_id"]).select("email_id", blob, F.lit("t").alias("thread_id"), F.col("flags").alias("server_flags"), "file_flags")
    one = lambda winner: R.adopted_flags(rows, winner).select(F.lit(winner).alias("winner"), "email_id", "action", "flags", "patch")
    return one("server").union(one("local"))


#: More of the server: messages of destroyed ids under new ones, doubles of messages that are alive, two ids for one new file.
_MORE_REMOTE = [("N", "% 20 = 0"), ("D", "% 30 = 1"), ("X", "% 40 = 18"), ("Y", "% 40 = 18")]
#: Uploads may have so many bytes; a file whose key ends in 28 of 40 has the message of a file that is there.
_LARGEST = 150_000
_ORDER = "SELECT o.o_orderkey AS k, o.o_custkey % 20 AS box, b.o_custkey % 20 AS other_box, c.o_custkey % 20 AS gone_box, CAST(floor(o.o_totalprice) AS BIGINT) AS size FROM orders o LEFT JOIN orders b ON b.o_orderkey = o.o_orderkey - 7 LEFT JOIN orders c ON c.o_orderkey = o.o_orderkey - 2"


def _rich(spark, d) -> R.Sides:
    s, k = _sides(spark, d), F.col("o_orderkey")
    o = table(spark, d, "orders")
    text = lambda p, c, q="": F.concat(F.lit(p), c.cast("string"), F.lit(q))
    remote = s.remote
    for p, which in _MORE_REMOTE:
        remote = remote.union(o.filter(f"o_orderkey {which}").select(text(p, k), text("<m", k, "@x>"), text("MB", F.col("o_custkey") % 20), F.lit("S"), F.lit(1).cast("bigint")))
    key = F.expr("substr(maildir_id, 2)").cast("long")
    local = s.local.withColumn("message_id", F.when(key % 40 == 28, text("<m", key - 7, "@x>")).otherwise(F.col("message_id")))
    return R.Sides(remote, s.cached, local, R.Policy(largest=_LARGEST))


@query(f"""
    WITH o AS ({_ORDER})
    SELECT concat('N', k) AS email_id, 'rebind' AS fate, concat('f', k) AS maildir_id, concat('E', k) AS old_email FROM o WHERE k % 20 = 0
    UNION ALL SELECT concat('D', k), 'alive', NULL, NULL FROM o WHERE k % 30 = 1 UNION ALL SELECT concat('X', k), 'adopt', concat('f', k), NULL FROM o WHERE k % 40 = 18
    UNION ALL SELECT concat('Y', k), 'claimed', NULL, NULL FROM o WHERE k % 40 = 18 UNION ALL SELECT concat('E', k), 'download', NULL, NULL FROM o WHERE k % 10 = 9
""")
def recon_arrivals(spark, d):
    """What becomes of messages that the cache doesn't know: by the cache's rows, by new files, by other ids that want the same."""
    return _rich(spark, d).arrivals().select("email_id", "fate", "maildir_id", "old_email")


@query(f"""
    WITH o AS ({_ORDER})
    SELECT concat('f', k) AS maildir_id, CASE WHEN k % 40 = 38 THEN CASE WHEN size > {_LARGEST} THEN 'too large' ELSE 'upload' END WHEN k % 40 = 28 THEN CASE WHEN box = other_box THEN 'adopt' ELSE 'elsewhere' END ELSE 'adopt' END AS fate,
           CASE WHEN k % 40 = 28 AND box = other_box THEN concat('E', k - 7) WHEN k % 40 = 8 THEN concat('E', k - 2) END AS email_id
    FROM o WHERE k % 40 IN (28, 38) OR k % 40 = 8 AND box = gone_box
""")
def recon_new_files(spark, d):
    """What becomes of new files: uploads, files of known messages, doubles of messages elsewhere, and those that are too large."""
    return _rich(spark, d).new_files().select("maildir_id", "fate", "email_id")


@query(f"""
    WITH o AS ({_ORDER})
    SELECT concat('D', k) AS email_id, NULL AS maildir_id, 'duplicate: alive' AS reason FROM o WHERE k % 30 = 1 UNION ALL SELECT concat('Y', k), NULL, 'duplicate: claimed' FROM o WHERE k % 40 = 18
    UNION ALL SELECT NULL, concat('f', k), 'duplicate: elsewhere' FROM o WHERE k % 40 = 28 AND box <> other_box UNION ALL SELECT NULL, concat('f', k), 'too large' FROM o WHERE k % 40 = 38 AND size > {_LARGEST}
""")
def recon_skip_reasons(spark, d):
    return _rich(spark, d).skips()


@query(f"""
    WITH o AS ({_ORDER}),
    keep AS (SELECT concat('E', k) AS email_id FROM o WHERE k % 10 BETWEEN 1 AND 7 OR k % 10 = 9 UNION ALL SELECT concat('N', k) FROM o WHERE k % 20 = 0 UNION ALL SELECT concat('X', k) FROM o WHERE k % 40 = 18),
    moved AS (SELECT concat('E', k - 2) AS email_id FROM o WHERE k % 40 = 8)
    SELECT email_id FROM keep WHERE CAST(substr(email_id, 2) AS BIGINT) % 10 <> 6 OR email_id IN (SELECT email_id FROM moved)
""")
def recon_rebound_state(spark, d):
    """The ids in the cache after a plan with rebinds and adoptions: old ids go, new ones come, deleted ones whose message isn't elsewhere are destroyed."""
    s = _rich(spark, d)
    return R.applied(s.cached, s.plan()).select("email_id")


_MAILBOXES = """
    WITH m AS (SELECT n_nationkey AS k, concat('MB', n_nationkey) AS mailbox_id, CASE WHEN n_nationkey % 8 <> 7 THEN n_name END AS cached, CASE WHEN n_nationkey % 3 = 1 THEN concat(n_name, '2') ELSE n_name END AS server,
        CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(n_name, '2') WHEN 2 THEN concat(n_name, '3') ELSE n_name END AS disk, n_nationkey % 7 = 2 AS ruled, n_nationkey % 11 <> 2 AS decomposes FROM nation)
"""
_DECIDED = """
    , t AS (SELECT *, CASE WHEN n_kind = 'n' THEN 'first_cycle' WHEN n_kind = 's' AND NOT ruled AND decomposes THEN CASE WHEN server_moved THEN 'conflict_local_wins' ELSE 'local_rename' END WHEN n_kind = 's' THEN 'unchanged'
        WHEN n_kind = 'e' THEN 'cache_stale' WHEN server_moved THEN 'server_rename' ELSE 'unchanged' END AS decision
      FROM (SELECT *, server <> cached AS server_moved, CASE WHEN cached IS NULL THEN 'n' WHEN disk IS NULL OR disk = cached THEN 'q' WHEN disk = server THEN 'e' ELSE 's' END AS n_kind FROM m))
"""


def _mailboxes(spark, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    two, three = F.concat(name, F.lit("2")), F.concat(name, F.lit("3"))
    return table(spark, d, "nation").select(
        F.concat(F.lit("MB"), k.cast("string")).alias("mailbox_id"), F.when(k % 8 != 7, name).alias("cached"), F.when(k % 3 == 1, two).otherwise(name).alias("server"),
        F.when(k % 5 == 1, two).when(k % 5 == 2, three).when(k % 5 > 2, name).alias("disk"), (k % 7 == 2).alias("ruled"), (k % 11 != 2).alias("decomposes"), (k % 5 > 2).alias("present"), (k % 2 == 0).alias("sentinel_fits"),
    )


@query(_MAILBOXES + _DECIDED + """
    SELECT mailbox_id, decision, CASE decision WHEN 'first_cycle' THEN 'new' WHEN 'server_rename' THEN 'pull' WHEN 'local_rename' THEN 'push' WHEN 'conflict_local_wins' THEN 'push' WHEN 'cache_stale' THEN 'metadata' ELSE 'none' END AS slot FROM t
""")
def mailbox_slots(spark, d):
    """Decisions where the local side wins, and what each leads to."""
    decided = D.decisions(_mailboxes(spark, d), "local")
    return decided.select("mailbox_id", "decision").join(D.slots(decided), "mailbox_id")


@query(_MAILBOXES + _DECIDED + """
    SELECT CAST(1 AS INTEGER) AS phase, 'create_local_mailbox' AS kind, mailbox_id, NULL AS source, server AS target, cached FROM t WHERE decision = 'first_cycle' OR decision = 'unchanged' AND k % 5 > 2 AND k % 2 = 1
    UNION ALL SELECT 2, 'rename_local_mailbox', mailbox_id, cached, server, cached FROM t WHERE decision = 'server_rename'
    UNION ALL SELECT 10, 'rename_remote_mailbox', mailbox_id, cached, disk, cached FROM t WHERE decision IN ('local_rename', 'conflict_local_wins')
""")
def folder_actions(spark, d):
    return D.folder_actions(D.decisions(_mailboxes(spark, d), "local"))


#: A cycle in which the server has no MB1 and MB4 any more, and the folders of MB7 and MB99 were deleted here. What is in the lost mailboxes isn't moved or deleted one by one.
_CYCLE = _BASE + _ADOPTED + _PLAN + _MAILBOXES.replace("WITH m AS", ", m AS") + _DECIDED + """
    , orphans AS (SELECT mailbox_id FROM (VALUES ('MB1'), ('MB4')) t(mailbox_id)), out AS (SELECT mailbox_id FROM (VALUES ('MB7'), ('MB99')) t(mailbox_id)),
    alive AS (SELECT * FROM plan WHERE NOT (kind IN ('move_local', 'delete_local') AND source IN (SELECT * FROM orphans))),
    home AS (SELECT p.*, c.mailbox_id AS home FROM alive p LEFT JOIN cached c ON p.email_id = c.email_id),
    role AS (SELECT *, CASE WHEN (kind IN ('upload', 'move_remote') OR phase = 16) AND target IN (SELECT * FROM orphans) THEN 'in' WHEN home IN (SELECT * FROM orphans) AND kind = 'update_remote_flags' THEN 'changed'
             WHEN home IN (SELECT * FROM orphans) AND kind IN ('move_remote', 'destroy_remote') THEN 'moot' END AS role FROM home),
    blocked AS (SELECT DISTINCT CASE WHEN role = 'in' THEN target ELSE home END AS mailbox_id FROM role WHERE role IN ('in', 'changed')),
    files AS (SELECT 11 AS phase, 'upload' AS kind, NULL AS email_id, maildir_id, NULL AS source, mailbox_id AS target FROM local),
    kept AS (SELECT phase, kind, email_id, maildir_id, source, target FROM role WHERE role IS NULL),
    folders AS (SELECT 1 AS phase, 'create_local_mailbox' AS kind, NULL AS email_id, NULL AS maildir_id, NULL AS source, server AS target FROM t WHERE decision = 'first_cycle' OR decision = 'unchanged' AND k % 5 > 2 AND k % 2 = 1
        UNION ALL SELECT 2, 'rename_local_mailbox', NULL, NULL, cached, server FROM t WHERE decision = 'server_rename'
        UNION ALL SELECT 10, 'rename_remote_mailbox', NULL, NULL, cached, disk FROM t WHERE decision IN ('local_rename', 'conflict_local_wins')),
"""
_BACK = """
    base AS (SELECT phase, kind, email_id, maildir_id, source, target FROM alive WHERE NOT (kind = 'upload' AND target IN (SELECT * FROM orphans))
        UNION ALL SELECT 9, 'create_remote_mailbox', NULL, NULL, NULL, mailbox_id FROM orphans UNION ALL SELECT * FROM files WHERE target IN (SELECT * FROM orphans)),
"""
_SERVER_WINS = """
    base AS (SELECT * FROM kept UNION ALL SELECT 6, 'move_local', email_id, maildir_id, target, source FROM role WHERE role = 'in' AND kind = 'move_remote' AND source NOT IN (SELECT * FROM orphans)
        UNION ALL SELECT 8, 'delete_local_folder', NULL, NULL, mailbox_id, NULL FROM orphans),
"""
_LOCAL_WINS = """
    base AS (SELECT * FROM kept UNION ALL SELECT 8, 'delete_local_folder', NULL, NULL, mailbox_id, NULL FROM orphans WHERE mailbox_id NOT IN (SELECT * FROM blocked)
        UNION ALL SELECT 9, 'create_remote_mailbox', NULL, NULL, NULL, mailbox_id FROM blocked UNION ALL SELECT * FROM files WHERE target IN (SELECT * FROM blocked)),
"""
#: What the plan has instead where the local side wins: deletions here hold against changes there, and files' flags go to the server.
_LOCAL_PLAN = """
    ours AS (SELECT * FROM plan WHERE NOT (kind = 'download' AND email_id IN (SELECT email_id FROM clash)) AND NOT (kind = 'update_local_flags' AND email_id IN (SELECT email_id FROM reflag UNION ALL SELECT email_id FROM again))
        UNION ALL SELECT 14, 'destroy_remote', email_id, maildir_id, old_box, NULL, NULL FROM clash
        UNION ALL SELECT 12, 'update_remote_flags', email_id, maildir_id, NULL, NULL, flags FROM reflag WHERE email_id NOT IN (SELECT email_id FROM dead) AND email_id IN (SELECT email_id FROM pair WHERE flags <> old_flags)
        UNION ALL SELECT 12, 'update_remote_flags', email_id, maildir_id, NULL, NULL, file_flags FROM again WHERE flags <> file_flags),
    alive AS (SELECT * FROM ours """
_KEPT = "after AS (SELECT * FROM base) SELECT * FROM after UNION ALL SELECT * FROM folders"
_GONE = """
    after AS (SELECT * FROM base WHERE target IS NULL OR target NOT IN (SELECT * FROM out) UNION ALL SELECT 13, 'move_remote', email_id, maildir_id, target, source FROM base WHERE kind = 'move_local' AND target IN (SELECT * FROM out) AND source NOT IN (SELECT * FROM out)
        UNION ALL SELECT 15, 'destroy_remote_mailbox', NULL, NULL, mailbox_id, NULL FROM out)
    SELECT * FROM after UNION ALL SELECT * FROM folders
"""


def _cycle_sql(*parts: str) -> str:
    lost = f"SELECT * FROM ({VIEWS['remote']}) WHERE mailbox_id NOT IN ('MB1', 'MB4')"
    return with_views("remote", "cached", "local", sql=_CYCLE + "".join(parts)).replace(VIEWS["remote"], lost)


def _cycle(spark, d, winner: str, deletes: str):
    """A whole cycle: folders, messages, mailboxes that the server lost, folders deleted here whose mailboxes go."""
    boxes = lambda *names: spark.createDataFrame([(n,) for n in names], "mailbox_id string")
    lost, policy = boxes("MB1", "MB4"), R.Policy(winner, deletes=deletes)
    sides = R.Sides(view(spark, d, "remote").join(lost, "mailbox_id", "left_anti"), view(spark, d, "cached"), view(spark, d, "local"), policy)
    return D.cycle_plan(sides, D.decisions(_mailboxes(spark, d), "local"), lost, boxes("MB7", "MB99"), policy)


@query(_cycle_sql(_BACK, _GONE))
def recon_cycle_plan(spark, d):
    """Lost mailboxes come back with their files; mailboxes of deleted folders go."""
    return _cycle(spark, d, "server", "remote")


@query(_cycle_sql(_BACK, _KEPT))
def recon_cycle_keeps(spark, d):
    """Neither side may delete."""
    return _cycle(spark, d, "server", "none")


@query(_cycle_sql(_SERVER_WINS, _KEPT))
def recon_cycle_server_wins(spark, d):
    """Folders of lost mailboxes go, with what was brought into them."""
    return _cycle(spark, d, "server", "local")


@query(_cycle_sql(_LOCAL_WINS, _GONE).replace("alive AS (SELECT * FROM plan ", _LOCAL_PLAN))
def recon_cycle_local_wins(spark, d):
    """Lost mailboxes into which something was brought are made anew with all their files, others go, as do mailboxes of deleted folders. The local side's flags win."""
    return _cycle(spark, d, "local", "both")


_STRUCTURAL = ", ".join(f"'{k}'" for k in R.STRUCTURAL_KINDS)


@query(f"SELECT bool_or(kind IN ({_STRUCTURAL})) AS structural, count(*) AS actions FROM ({_cycle_sql(_BACK, _KEPT)})")
def plan_structural_flag(spark, d):
    """Whether a cycle changes the tree of mailboxes, so that a one-way run must be refused."""
    plan = _cycle(spark, d, "server", "none")
    return plan.agg(F.bool_or(F.col("kind").isin(*R.STRUCTURAL_KINDS)).alias("structural"), F.count("*").alias("actions"))
