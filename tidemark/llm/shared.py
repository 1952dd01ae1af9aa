"""Rows by lists of ids, first rows of repeated keys, and what the operators share otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir, written  # noqa: F401

#: Ids of one long each are broadcast up to so many (some 100 MB on an executor); beyond that the rows that they select are shuffled.
BROADCAST_IDS = 2_000_000


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids (id, each once). Whole texts stay where they are unless there are more than BROADCAST_IDS ids."""
    ids = written(ids.select("id"), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id isn't among ids (id, each once), those without an id too. Texts stay where they are as in only."""
    ids = written(ids.select(F.col("id").alias("__tidemark_out")), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, rows[id_col] == ids["__tidemark_out"], "left_anti")


def first_of_repeats(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row of those that share a key, the first by order; rows without a key all stay.

    Only keys are shuffled to find those that repeat, and only the rows of these are put in order; each task sends one row of a key.
    """
    several = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__tidemark_several")).count().filter("count > 1").select("__tidemark_several")
    several = written(several, "repeats")
    n = several.count()
    if not n:
        return rows
    ids = F.broadcast(several) if n <= BROADCAST_IDS // 8 else several
    same = rows[key] == several["__tidemark_several"]
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(key) if order is None else order))
    firsts = rows.join(ids, same, "left_semi").withColumn("__tidemark_nth", nth).filter("__tidemark_nth = 1").drop("__tidemark_nth")
    return rows.join(ids, same, "left_anti").union(firsts)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most 256 rows or about 16 MB, where the session has Spark's own limits."""
    for key, usual, own in (("maxRecordsPerBatch", "10000", "256"), ("maxBytesPerBatch", None, str(1 << 24))):
        key = f"spark.sql.execution.arrow.{key}"
        if usual is None or spark.conf.get(key) == usual:
            spark.conf.set(key, own)
