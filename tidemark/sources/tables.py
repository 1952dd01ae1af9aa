"""Tables of a folder of Parquet files, and the message store's views over them.

The views' SQL is plain enough to run in Spark and in DuckDB, so that both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")

#: Stored messages: a file for each document; the anchor is what copies of a message share.
MESSAGES = """
    SELECT doc_id, CAST(doc_id AS STRING) AS maildir_id, source AS folder, md5(text) AS message_id, n_chars AS size,
           doc_id AS mtime, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'cur' END AS subdir, text AS body
    FROM documents
"""
_FLAGS = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'FS' WHEN '2' THEN 'F' WHEN '3' THEN 'S' WHEN '4' THEN '' ELSE 'RS' END"
_OTHER = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'F' WHEN '2' THEN 'FS' WHEN '3' THEN '' WHEN '4' THEN 'S' ELSE 'R' END"
_KEYS = "concat('E', o_orderkey) AS email_id, concat('<m', o_orderkey, '@x>') AS message_id"

#: The last state that both sides agreed on. Orders whose key ends in 0 to 7 were known; those in 8 and 9 came later.
CACHED = f"""
    SELECT {_KEYS}, concat('MB', o_custkey % 20) AS mailbox_id, concat('f', o_orderkey) AS maildir_id, {_FLAGS} AS flags
    FROM orders WHERE o_orderkey % 10 < 8
"""
#: What the server has: 0 was destroyed, 2 moved, 3, 5 and 7 got other flags, 9 is new.
REMOTE = f"""
    SELECT {_KEYS}, concat('MB', CASE WHEN o_orderkey % 10 = 2 THEN (o_custkey + 1) % 20 ELSE o_custkey % 20 END) AS mailbox_id,
           CASE WHEN o_orderkey % 10 IN (3, 5, 7) THEN {_OTHER} ELSE {_FLAGS} END AS flags, CAST(floor(o_totalprice) AS BIGINT) AS size
    FROM orders WHERE o_orderkey % 10 NOT IN (0, 8)
"""
#: What the disk has: 4 and 5 got other flags, 6 and 7 are gone, 8 is new (some are moves: a gone file's message in another folder).
LOCAL = f"""
    SELECT concat('f', o_orderkey) AS maildir_id,
           CASE WHEN o_orderkey % 40 = 8 THEN concat('<m', o_orderkey - 2, '@x>') ELSE concat('<m', o_orderkey, '@x>') END AS message_id,
           concat('MB', o_custkey % 20) AS mailbox_id, CASE WHEN o_orderkey % 10 IN (4, 5) THEN {_OTHER} ELSE {_FLAGS} END AS flags,
           CAST(floor(o_totalprice) AS BIGINT) AS size
    FROM orders WHERE o_orderkey % 10 NOT IN (6, 7, 9)
"""
#: Mailboxes: regions, nations below them and customers below those.
TREE = """
    SELECT concat('R', r_regionkey) AS id, r_name AS name, CAST(NULL AS STRING) AS parent_id, CASE WHEN r_regionkey = 0 THEN 'inbox' END AS role FROM region
    UNION ALL SELECT concat('N', n_nationkey), n_name, concat('R', n_regionkey), NULL FROM nation
    UNION ALL SELECT concat('C', c_custkey), c_name, concat('N', c_nationkey), NULL FROM customer
"""
#: Triggers of the watching process, one for each event.
TRIGGERS = """
    SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'Initial' WHEN 'purchase' THEN 'Manual' WHEN 'error' THEN 'RemoteChange'
           WHEN 'view' THEN 'Structural' ELSE 'LocalChange' END AS kind
    FROM events
"""
#: Transfers, with a direction, a phase, bytes and a time.
TRANSFERS = """
    SELECT l_orderkey, l_linenumber, l_returnflag AS direction, l_linestatus AS phase, CAST(l_quantity AS BIGINT) AS bytes, l_shipdate AS ts FROM lineitem
"""
VIEWS = {"messages": MESSAGES, "cached": CACHED, "remote": REMOTE, "local": LOCAL, "tree": TREE, "triggers": TRIGGERS, "transfers": TRANSFERS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def with_views(*names: str, sql: str) -> str:
    """DuckDB SQL that begins with some of VIEWS."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql
