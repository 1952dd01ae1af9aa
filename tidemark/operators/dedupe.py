"""Duplicates of stored messages: local ones by age, remote ones verified by size and digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import same_or_extended


def exempt_groups(files: DataFrame, keys: list[str], id_col: str = "maildir_id") -> DataFrame:
    """keys of groups in which a file of cur and one of new are the same name, or one extends the other: a message on its way.

    A name meets the names it may extend by an equi-join on its prefixes up to a comma, not pair by pair.
    """
    prefixes = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(id_col, ","))), lambda n: F.array_join(F.slice(F.split(id_col, ","), 1, n), ",")), lambda p: p != "")
    longer = files.select(*keys, F.col("subdir").alias("_other"), F.explode(prefixes).alias("_name"))
    shorter = files.select(*keys, "subdir", F.col(id_col).alias("_name"))
    return shorter.join(longer, [*keys, "_name"]).filter(F.col("subdir") != F.col("_other")).select(*keys).distinct()


def dedupe_plan(files: DataFrame, exempt: bool = True) -> DataFrame:
    """(folder, message_id, maildir_id, kept_id) of files to delete: all but the oldest of a message in a folder; ties go to the smaller name.

    Files without a message id take no part. The kept file comes from an aggregate, which a join carries to the others, so that a
    message with very many copies is split over tasks.
    """
    known = files.filter(F.col("message_id").isNotNull())
    kept = known.groupBy("folder", "message_id").agg(F.min(F.struct("mtime", "maildir_id")).alias("_k"), F.count("*").alias("_n")).filter("_n > 1")
    if exempt:
        kept = kept.join(exempt_groups(known, ["folder", "message_id"]), ["folder", "message_id"], "left_anti")
    both = known.join(kept, ["folder", "message_id"]).filter(F.col("maildir_id") != F.col("_k.maildir_id"))
    return both.select("folder", "message_id", "maildir_id", F.col("_k.maildir_id").alias("kept_id"))


def remote_verdicts(messages: DataFrame, keys: list[str], size: Column, digest: Column) -> DataFrame:
    """(keys, n, verdict): single; size mismatch; content mismatch; or matched, if all of a group have one size and one digest."""
    g = messages.groupBy(*keys).agg(F.count("*").alias("n"), F.min(size).alias("_a"), F.max(size).alias("_b"), F.min(digest).alias("_c"), F.max(digest).alias("_d"))
    verdict = F.when(F.col("n") == 1, "single").when(F.col("_a") != F.col("_b"), "size mismatch").when(F.col("_c") != F.col("_d"), "content mismatch").otherwise("matched")
    return g.select(*keys, "n", verdict.alias("verdict"))


def remote_dedupe_plan(messages: DataFrame, keys: list[str], size: Column, digest: Column, bound: Column, id_col: str) -> DataFrame:
    """(keys, id, survivor) of messages to destroy in groups whose copies match. The survivor is bound locally, or else has the smallest id."""
    verdicts = remote_verdicts(messages, keys, size, digest).filter("verdict = 'matched'").drop("n", "verdict")
    best = messages.groupBy(*keys).agg(F.min_by(F.col(id_col), F.struct(F.when(bound, 0).otherwise(1), F.col(id_col))).alias("survivor"))
    return messages.join(verdicts.join(best, keys), keys).filter(F.col(id_col) != F.col("survivor")).select(*keys, id_col, "survivor")
