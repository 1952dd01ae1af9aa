"""Folders that all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes shuffle files at the end of the query that wrote them, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Masters whose executors may be on other machines.
REMOTE = ("local-cluster", "spark:", "yarn", "k8s:")

_lock = threading.Lock()
_writing: dict[str, int] = {}
_before: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that spark.checkpoint.dir names. Where that is unset a local one is made, if all tasks run on this machine; else that is an error.

    It goes when the driver's Python ends.
    """
    found = spark.conf.get("spark.tidemark.sharedDir", None)
    if not found:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if spark.sparkContext.master.startswith(REMOTE):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        found = f"{top.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.tidemark.sharedDir", found)
        atexit.register(_removed, spark, found)
    return found


def _removed(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """CLEANUP holds inside; the session's own value is back when the last of several threads is out."""
    key = spark.sparkContext.applicationId
    with _lock:
        if not _writing.get(key):
            _before[key] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writing[key] = _writing.get(key, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _writing[key] -= 1
            if not _writing[key]:
                spark.conf.set(CLEANUP, _before[key])


def shared_uri(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and the authority that Spark gives it: a path without a scheme is one of the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that all executors share, as shared_uri names it, and the path there."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":", "://", 1))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lost executors don't lose it. What was shuffled for it is given up at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
