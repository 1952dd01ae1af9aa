"""Messages as files, `<folder>/cur/<id>!2,<flags>` and `<folder>/new/<id>`, listed by tasks.

A scan for names and flags doesn't open a file: headers are a column that Spark leaves out where no one asks for it. Spark's binaryFile source isn't used: it lists
all files in the driver, reads them whole, and puts some 32 small ones in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources.shared import opened, shared_uri

#: What stands for the colon before flags: Hadoop's paths can't have one in a file's name.
MARK = "!"
#: Bytes of a file in which its header is looked for.
HEADER = 1 << 16
#: Files in a batch of a folder's list.
LISTED = 10_000


def deliver(messages: DataFrame, root: str) -> int:
    """Writes messages (folder, subdir, maildir_id, flags, message_id, body) as files below root, and returns how many. A file that is written again is the same one."""
    at = shared_uri(messages.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(at)
        made = set()
        for b in batches:
            for m in b.to_pylist():
                folder = f"{top}/{m['folder']}/{m['subdir']}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                name = m["maildir_id"] + (f"{MARK}2,{m['flags']}" if m["subdir"] == "cur" else "")
                with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(f"Message-ID: <{m['message_id']}>\r\nSubject: t\r\n\r\n{m['body'] or ''}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = messages.select("folder", "subdir", "maildir_id", "flags", "message_id", "body")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _boxes(uri: str) -> list[str]:
    """The folders cur and new below a root, as paths from there; their own files aren't listed for that."""
    fs, top = opened(uri)
    found, left = [], [top]
    while left:
        for f in fs.get_file_info(pa.fs.FileSelector(left.pop(), allow_not_found=True)):
            if f.type == pa.fs.FileType.Directory:
                (found if f.base_name in ("cur", "new") else left).append(f.path)
    return sorted(f[len(top.rstrip("/")) + 1:] for f in found)


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """(folder, subdir, maildir_id, flags, size, header) of the message files below root; those of new have no flags. Left out of a query, header is never read.

    The driver knows the folders alone: a task lists the files of some, which are then dealt out for their headers. A folder's list is in one task's memory.
    """
    at = shared_uri(spark, root).rstrip("/")

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(at)
        skip = len(top.rstrip("/")) + 1
        for b in batches:
            for box in b["box"].to_pylist():
                files = [f for f in fs.get_file_info(pa.fs.FileSelector(f"{top}/{box}", recursive=True)) if f.is_file and not f.base_name.startswith(".")]
                for k in range(0, len(files), LISTED):
                    part = files[k : k + LISTED]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path[skip:] for f in part], pa.string()), pa.array([f.size for f in part], pa.int64())], ["path", "size"])

    @F.pandas_udf("string")
    def content(paths: pd.Series) -> pd.Series:
        fs, top = opened(at)
        return paths.map(lambda path: header_at(fs, f"{top}/{path}"))

    boxes = _boxes(at)
    tasks = max(1, min(len(boxes), 256))
    files = spark.createDataFrame([(b,) for b in boxes], "box string").repartition(tasks).mapInArrow(listing, "path string, size long").repartition(max(tasks, 2 * spark.sparkContext.defaultParallelism))
    below = F.replace("path", F.lit(f"{MARK}2,"), F.lit(":2,"))
    return files.select(T.event_path(below).alias("p"), "size", content("path").alias("header")).filter("p IS NOT NULL").select("p.folder", "p.subdir", F.col("p.id").alias("maildir_id"), F.when(F.col("p.subdir") == "new", F.lit("")).otherwise(F.col("p.flags")).alias("flags"), "size", "header")


def header_at(fs: pa.fs.FileSystem, path: str) -> str:
    """The text before a file's first empty line. Bytes that aren't UTF-8 are replaced: a cut at HEADER may go through a character, and bodies may be in any code."""
    with fs.open_input_stream(path, compression=None) as f:
        return re.split(rb"\r?\n\r?\n", f.read(HEADER), maxsplit=1)[0].decode("utf-8", "replace")


def message_id(header: Column) -> Column:
    return T.message_id(F.regexp_extract(header, r"(?im)^message-id:[ \t]*([^\r\n]*)", 1))
