"""Tables kept in buckets of a key, so that changes rewrite the buckets that they touch and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Buckets of a table; a column of this name tells them apart.
BUCKETS, BUCKET = 64, "bucket"


def bucketed(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> None:
    """Writes rows (key each once) as a table of buckets."""
    bucketed(rows, key, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.withColumn(BUCKET, F.lit(0)).schema).parquet(folder)


def upsert(spark: SparkSession, folder: str, rows: DataFrame, key: str, gone: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Puts rows (all columns, key each once) in the place of those with their keys, and leaves out those of gone (key). Returns the buckets that were written.

    Only those buckets are read and written, each whole, by a dynamic partition overwrite. A table is written by one writer at a time; one that is lost midway leaves old buckets as they were.
    """
    new = written(bucketed(rows, key, buckets), "upserts")
    out = bucketed(new.select(key) if gone is None else new.select(key).union(gone.select(key)), key, buckets).distinct()
    out = written(out, "keys")
    touched = sorted(r[0] for r in out.select(BUCKET).distinct().collect())  # no more than there are buckets
    if not touched:
        return []
    old = read(spark, folder, rows).filter(F.col(BUCKET).isin(touched))
    kept = old.join(out, [BUCKET, key], "left_anti").select(*new.columns)
    # Buckets that are left without rows have to be overwritten too, so that what was in them goes.
    merged = written(kept.unionByName(new), "merged")
    full = {r[0] for r in merged.select(BUCKET).distinct().collect()}
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)
    for b in sorted(set(touched) - full):
        _emptied(spark, f"{folder}/{BUCKET}={b}")
    return touched


def _emptied(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def outcomes(planned: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """What was planned (key and new columns) for keys whose change didn't fail (failed: key): others keep their rows as they are."""
    return planned.join(failed.select(key).distinct(), key, "left_anti")
