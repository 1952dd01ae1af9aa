"""Queries over the mailbox tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import hierarchy as H
from tidemark.registry import query
from tidemark.sources.tables import table, view, with_views

_PATHS = """
    , p AS (SELECT id, name AS path, 0 AS depth FROM tree WHERE parent_id IS NULL
            UNION ALL SELECT t.id, concat(p.path, '/', t.name), p.depth + 1 FROM tree t JOIN p ON t.parent_id = p.id)
"""


@query(with_views("tree", sql=_PATHS + "SELECT id, path, depth FROM p"))
def mailbox_paths(spark, d):
    return H.paths(view(spark, d, "tree")).select("id", "path", "depth")


@query(with_views("tree", sql=_PATHS + "SELECT id, path FROM p WHERE lower(path) = 'europe/france' OR path IN ('ASIA', 'AFRICA') OR id IN (SELECT id FROM tree WHERE role = 'inbox')"))
def mailbox_select_exact(spark, d):
    """Mailboxes at named paths (one in any case), and the one whose role is inbox."""
    t = view(spark, d, "tree")
    names = spark.createDataFrame([("Europe/france", True), ("ASIA", False), ("AFRICA", False), ("europe", False), ("INBOX", False)], "name string, any_case boolean")
    return H.named(H.paths(t).join(t.select("id", "role"), "id").select("id", "path", "role"), names).select("id", "path")


@query(with_views("tree", sql=_PATHS + "SELECT id, path FROM p WHERE path IN ('ASIA', 'EUROPE/FRANCE') OR starts_with(path, 'ASIA/') OR starts_with(path, 'EUROPE/FRANCE/') OR split_part(path, '/', 2) IN (SELECT n_name FROM nation WHERE n_nationkey = 3)"))
def mailbox_select_subtree(spark, d):
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey = 3").select(F.concat_ws("/", "r_name", "n_name")).first()
    return H.select_subtrees(H.paths(view(spark, d, "tree")), "path", ["ASIA", "EUROPE/FRANCE", t[0]]).select("id", "path")


@query(with_views("tree", sql=_PATHS + "SELECT id, replace(path, '/', '.') AS flat, concat('.', replace(path, '/', '.')) AS maildirpp, strlen(path) > 30 AS too_long FROM p"))
def layout_encode(spark, d):
    p = H.paths(view(spark, d, "tree"))
    return p.select("id", H.encoded(F.col("path"), "flat").alias("flat"), H.encoded(F.col("path"), "maildir++").alias("maildirpp"), (F.octet_length("path") > 30).alias("too_long"))


@query(with_views("tree", sql=_PATHS + "SELECT p.id, t.name AS leaf, replace(q.path, '/', '.') AS parent FROM p JOIN tree t USING (id) LEFT JOIN p q ON q.id = t.parent_id"))
def layout_decode(spark, d):
    p = H.paths(view(spark, d, "tree"))
    leaf, parent = H.decoded(H.encoded(F.col("path"), "flat"))
    return p.select("id", leaf.alias("leaf"), parent.alias("parent"))


@query(with_views("tree", sql=_PATHS + r"SELECT id, CASE WHEN path = 'ASIA' THEN 'Orient' WHEN regexp_matches(path, '^ASIA/(.)') THEN regexp_replace(path, '^ASIA/(.)', 'Orient/\1', 'g') WHEN regexp_matches(path, 'Customer#0+([0-9]+)') THEN regexp_replace(path, 'Customer#0+([0-9]+)', 'c\1', 'g') END AS renamed FROM p"))
def rename_rules(spark, d):
    rules = [("exact", "ASIA", "Orient"), ("regex", "^ASIA/(.)", "Orient/$1"), ("regex", "Customer#0+([0-9]+)", "c$1")]
    return H.paths(view(spark, d, "tree")).select("id", H.renamed(F.col("path"), rules).alias("renamed"))


@query(with_views("tree", sql=_PATHS + """
    , bound AS (SELECT path FROM p WHERE depth = 0 OR id IN ('N1', 'N2', 'N3')),
    want AS (SELECT path FROM p WHERE depth = 2 AND length(path) % 3 = 0),
    up AS (SELECT path FROM want UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM up WHERE contains(path, '/'))
    SELECT path AS folder, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM up WHERE path NOT IN (SELECT path FROM bound)
"""))
def folder_create_chain(spark, d):
    p = H.paths(view(spark, d, "tree")).withColumnRenamed("path", "folder")
    bound = p.filter((F.col("depth") == 0) | F.col("id").isin("N1", "N2", "N3"))
    return H.creation_chain(p.filter("depth = 2 AND length(folder) % 3 = 0").select("folder"), bound)


@query(with_views("tree", sql=_PATHS + """
    SELECT p.id, replace(p.path, '/', '.') AS disk_name, t.role, count(c.id) AS total, count(c.id) FILTER (substr(c.id, -1) = '1') AS unread, CASE WHEN starts_with(p.path, 'ASIA') THEN '*' ELSE '' END AS selected
    FROM p JOIN tree t USING (id) LEFT JOIN tree c ON c.parent_id = p.id GROUP BY ALL
"""))
def mailbox_report(spark, d):
    t = view(spark, d, "tree")
    counts = t.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("id").endswith("1")).alias("unread"))
    p = H.paths(t).join(t.select("id", "role"), "id").join(counts, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return p.select("id", H.encoded(F.col("path"), "flat").alias("disk_name"), "role", zero("total"), zero("unread"), F.when(F.col("path").startswith("ASIA"), "*").otherwise("").alias("selected"))


@query(with_views("tree", sql=_PATHS + "SELECT DISTINCT a.path FROM p a JOIN p b ON starts_with(b.path, concat(a.path, '/')) WHERE b.depth = 2"))
def nested_folders(spark, d):
    """Folders that have a customer's folder somewhere below them."""
    p = H.paths(view(spark, d, "tree"))
    below = p.filter("depth = 2").select(F.explode(F.slice("ids", F.lit(1), F.size("ids") - 1)).alias("id")).distinct()
    return p.join(below, "id", "left_semi").select("path")


@query(r"""
    WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://[^/]*/?', ''), '/', CASE WHEN page_id % 3 = 0 THEN '/../' WHEN page_id % 3 = 1 THEN '/../../' ELSE '/' END) AS path FROM pages),
    s AS (SELECT page_id, path, i, CASE WHEN part = '..' THEN -1 WHEN part IN ('', '.') THEN 0 ELSE 1 END AS step FROM (SELECT page_id, path, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS i FROM p)),
    d AS (SELECT page_id, path, sum(step) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM s)
    SELECT page_id, path LIKE '/%' OR min(depth) < 0 AS escapes FROM d GROUP BY page_id, path
""")
def path_escape(spark, d):
    """Paths of urls, some led astray, that go out of the folder that they are taken below."""
    up = F.when(F.col("page_id") % 3 == 0, "/../").when(F.col("page_id") % 3 == 1, "/../../").otherwise("/")
    path = F.regexp_replace("url", "^[^:]*://[^/]*/?", "")
    first = F.instr(path, "/")
    path = F.when(first > 0, F.concat(F.substring(path, F.lit(1), first - 1), up, F.substring(path, first + 1, F.length(path)))).otherwise(path)
    return table(spark, d, "pages").select("page_id", T.leaves(path).alias("escapes"))


@query("""
    SELECT DISTINCT 'flat' AS layout, source AS folder FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) UNION ALL SELECT DISTINCT 'flat', concat('.', source) FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT DISTINCT 'maildir++', concat('.', source) FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT DISTINCT 'fs', source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) UNION ALL SELECT DISTINCT 'fs', concat('.', source) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT DISTINCT 'fs', concat(source, '/', lang) FROM documents WHERE doc_id % 3 = 1
""")
def unbound_folders(spark, d):
    """Folders without a mailbox, by what each layout takes for a folder."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    names = F.array(F.col("source"), F.when(k % 3 == 0, F.concat(F.lit("."), "source")), F.when(k % 3 == 1, F.concat_ws("/", "source", "lang")), F.concat(F.lit(".tidemark."), "source"))
    folders = docs.select(F.explode(F.array_compact(names)).alias("folder"))
    bound = docs.filter(k % 97 == 0).select(F.col("source").alias("folder")).distinct()
    out = [H.unbound(folders, bound, x).select(F.lit(x).alias("layout"), "folder") for x in ("flat", "maildir++", "fs")]
    return out[0].union(out[1]).union(out[2])


@query(with_views("tree", sql=_PATHS + """
    SELECT p.id, t.name AS leaf, CASE WHEN t.parent_id IS NOT NULL THEN concat('.', replace(q.path, '/', '.')) END AS plus_parent, q.path AS fs_parent FROM p JOIN tree t USING (id) LEFT JOIN p q ON q.id = t.parent_id
"""))
def layout_decode_all(spark, d):
    """Leaves and parents of the same paths in the layouts with a leading dot and with real folders."""
    p = H.paths(view(spark, d, "tree"))
    plus, fs = (H.decoded(H.encoded(F.col("path"), x), layout=x) for x in ("maildir++", "fs"))
    return p.filter(plus[0] == fs[0]).select("id", plus[0].alias("leaf"), plus[1].alias("plus_parent"), fs[1].alias("fs_parent"))


@query(with_views("tree", sql=_PATHS + "SELECT p.path AS folder, t.name AS leaf, CASE WHEN t.parent_id NOT IN ('N3', 'R2') THEN t.parent_id END AS parent_id, CASE WHEN t.parent_id IN ('N3', 'R2') THEN 'unknown parent' END AS fault FROM p JOIN tree t USING (id)"))
def disk_parents(spark, d):
    """Folders with the id of their parent; two parents aren't known."""
    p = H.paths(view(spark, d, "tree"))
    known = p.filter(~F.col("id").isin("N3", "R2")).select(F.col("path").alias("folder"), F.col("id").alias("mailbox_id"))
    return H.with_parents(p.select(F.col("path").alias("folder")), known, "fs").select("folder", "leaf", "parent_id", "fault")


@query(with_views("tree", sql=_PATHS + "SELECT id, CASE WHEN contains(path, '.') THEN 'separator' WHEN strlen(path) > 30 THEN 'too long' END AS flat, CASE WHEN contains(path, '.') THEN NULL WHEN strlen(path) - 1 >= 30 THEN 'too long' END AS plus FROM p"))
def layout_faults(spark, d):
    """Paths that a layout has no folder for."""
    p = H.paths(view(spark, d, "tree"))
    plus = H.folder_fault(F.replace("path", F.lit("."), F.lit("_")), "maildir++", cap=30)
    return p.select("id", H.folder_fault(F.col("path"), "flat", cap=30).alias("flat"), plus.alias("plus"))


@query("""
    WITH a AS (SELECT n_nationkey AS account, n_nationkey % 5 <> 0 AND NOT coalesce((SELECT bool_or(s_suppkey % 7 = 3 OR s_suppkey % 11 = 4) FROM supplier WHERE s_nationkey = n_nationkey), FALSE) AS reused FROM nation),
    m AS (SELECT c_nationkey AS account, concat('C', c_custkey) AS mailbox_id, c_name AS folder, CASE WHEN c_custkey % 3 = 0 THEN concat('C', c_custkey - 1) END AS parent_id, c_custkey AS k FROM customer)
    SELECT account, mailbox_id, folder, parent_id, CASE WHEN reused THEN 0 ELSE k END AS total, CASE WHEN reused THEN 0 ELSE k % 7 END AS unread, reused FROM a JOIN m USING (account) WHERE NOT reused OR k % 2 = 0
""")
def mailbox_choice(spark, d):
    """Each account's mailboxes: those that the cache has, if only counts changed, else the server's."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("C"), c.cast("string"))
    accounts = table(spark, d, "nation").select(F.col("n_nationkey").alias("account"), F.when(F.col("n_nationkey") % 5 != 0, "s").alias("cursor"))
    pages = table(spark, d, "supplier").select(F.col("s_nationkey").alias("account"), s.alias("n"), (s % 7 == 3).alias("structural"), (s % 11 == 4).alias("failed"))
    server = table(spark, d, "customer").select(F.col("c_nationkey").alias("account"), name(k).alias("mailbox_id"), F.col("c_name").alias("folder"), F.when(k % 3 == 0, name(k - 1)).alias("parent_id"), k.alias("total"), (k % 7).alias("unread"))
    return H.listed_or_reused(accounts, pages, server, server.filter("total % 2 = 0"))
