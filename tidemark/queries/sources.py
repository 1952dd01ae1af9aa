"""Queries on sources of their own: paged lists, message files, and tables that are changed bucket by bucket. What they read is first laid out from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import buckets, dedupe
from tidemark.operators.reconcile import local_changes
from tidemark.registry import ORACLE, query
from tidemark.sources import maildir, pages
from tidemark.sources.shared import shared_dir, written
from tidemark.sources.tables import table, view, with_views


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(ORACLE["mailbox_members"])
def mailbox_pages(spark, d):
    """One mailbox's members from a paged list of all: only pages that may have some are read, each by a task of its own."""
    rows, folder = view(spark, d, "remote").select("mailbox_id", "email_id", "flags"), _folder(spark, "list")
    pages.lay_out(rows, folder, ["mailbox_id", "email_id"], 500)
    return pages.listed(spark, folder, rows.schema).filter("mailbox_id = 'MB3'").select("email_id", "flags")


def change_log(spark, d):
    """(id, op, state): a change for each line of an order; the state is its time."""
    n = F.col("l_linenumber")
    op = F.when(n == 1, 0).when(n == 7, 2).otherwise(1)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), op.alias("op"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("state"))


@query(ORACLE["delta_collect"])
def delta_pages(spark, d):
    """Ids of the change pages after a state; where the log doesn't reach back so far any more, those of the whole list are created."""
    log, folder = change_log(spark, d), _folder(spark, "log")
    pages.lay_out(log, folder, ["state", "id"], 2000)
    since = pages.changes_since(spark, folder, log.schema, 820_454_400_000_000 - 1)
    since = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("op")) if since is None else since
    return since.groupBy("id").agg(F.min("op").alias("first_op"), (F.max("op") == 2).alias("destroyed"))


def delivered(spark, d):
    """The root of a file for each document; those that were read are in cur."""
    m = view(spark, d, "messages")
    flags = F.when(F.col("doc_id") % 6 == 2, "S").otherwise("")
    root = _folder(spark, "mail")
    maildir.deliver(m.withColumn("subdir", F.when(F.col("doc_id") % 6 == 2, "cur").otherwise(F.col("subdir"))).withColumn("flags", flags), root)
    return root


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS id, source AS folder, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE 'flags' END AS kind FROM documents WHERE doc_id % 6 IN (0, 2)
    UNION ALL SELECT concat('gone', doc_id), source, 'deleted' FROM documents WHERE doc_id % 6 = 5
""")
def scan_files_diff(spark, d):
    """Message files against what was known of them: every sixth is new, every sixth was read since, and some that were known are gone. No file is opened."""
    k = F.col("doc_id")
    m = view(spark, d, "messages").select(k, F.col("folder").alias("mailbox_id"), "message_id", "maildir_id", F.lit("").alias("flags"))
    known = m.filter("doc_id % 6 <> 0").unionByName(m.filter("doc_id % 6 = 5").withColumn("maildir_id", F.concat(F.lit("gone"), "maildir_id"))).drop("doc_id")
    disk = maildir.scanned(spark, delivered(spark, d)).select("maildir_id", F.lit("").alias("message_id"), F.col("folder").alias("mailbox_id"), "flags", "size")
    return local_changes(disk, known).select(F.col("maildir_id").alias("id"), F.col("mailbox_id").alias("folder"), "kind")


@query(ORACLE["dedupe_plan"])
def dedupe_files(spark, d):
    """Copies of messages in one folder, by the ids in their files' headers; a file's name begins with its time."""
    files = maildir.scanned(spark, delivered(spark, d))
    mtime = F.regexp_extract("maildir_id", r"^\d+", 0).cast("long")
    # The plan reads its files several times; they are opened once.
    return dedupe.dedupe_plan(written(files.select("folder", maildir.message_id(F.col("header")).alias("message_id"), "maildir_id", mtime.alias("mtime"), "subdir"), "files"))


@query("""
    SELECT folder, subdir, maildir_id, flags, size FROM (SELECT source AS folder, CASE WHEN doc_id % 6 = 2 OR doc_id % 10 <> 0 THEN 'cur' ELSE 'new' END AS subdir, CAST(doc_id AS VARCHAR) AS maildir_id,
        CASE WHEN doc_id % 6 = 2 THEN 'S' ELSE '' END AS flags, 62 + strlen(text) AS size FROM documents)
""")
def file_flags(spark, d):
    """The flags of each message file by its name."""
    return maildir.scanned(spark, delivered(spark, d)).drop("header")


@query(with_views("cached", "remote", "local", sql="""
    , t AS (SELECT c.email_id, c.mailbox_id, c.maildir_id, c.flags AS server_flags, c.flags AS file_flags FROM cached c),
    p AS (SELECT r.email_id, r.mailbox_id, l.maildir_id, r.flags AS server_flags, l.flags AS file_flags, CAST(substr(r.email_id, 2) AS BIGINT) % 13 = 0 AS failed FROM remote r JOIN local l ON substr(l.maildir_id, 2) = substr(r.email_id, 2)),
    g AS (SELECT email_id FROM cached WHERE CAST(substr(email_id, 2) AS BIGINT) % 10 = 0)
    SELECT email_id, mailbox_id, maildir_id, server_flags, file_flags FROM p WHERE NOT failed
    UNION ALL SELECT * FROM t WHERE email_id NOT IN (SELECT email_id FROM p WHERE NOT failed) AND email_id NOT IN (SELECT email_id FROM g)
"""))
def upsert_buckets(spark, d):
    """Both caches' flags after a cycle: the server's keywords and the file's name give one each; failed messages keep their rows, destroyed ones go."""
    number = lambda c: F.substring(c, 2, 20)
    cache = view(spark, d, "cached").select("email_id", "mailbox_id", "maildir_id", F.col("flags").alias("server_flags"), F.col("flags").alias("file_flags"))
    server, files = view(spark, d, "remote"), view(spark, d, "local").select(number("maildir_id").alias("k"), "maildir_id", F.col("flags").alias("file_flags"))
    planned = server.withColumn("k", number("email_id")).join(files, "k").select("email_id", "mailbox_id", "maildir_id", F.col("flags").alias("server_flags"), "file_flags")
    failed = server.filter(number("email_id").cast("long") % 13 == 0)
    folder = _folder(spark, "cache")
    buckets.create(cache, folder, "email_id")
    buckets.upsert(spark, folder, buckets.outcomes(planned, failed, "email_id"), "email_id", gone=cache.filter(number("email_id").cast("long") % 10 == 0))
    return buckets.read(spark, folder, cache).drop(buckets.BUCKET)
