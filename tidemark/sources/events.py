"""A source of events for streams: a folder of slots, each a stretch of time, read in order with offsets and commits.

spool lays events out; Slots is a Spark data source that streams them. An offset is the number of slots read, so that a query that
goes on from its checkpoint reads each event once. With purge, slots go when the query has committed them, as from a queue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.shared import opened, shared_uri

#: Rows of a slot that a task reads, at most.
GROUP = 200_000


def spool(events: DataFrame, folder: str, slots: int, time: str = "ts", tick: bool = True) -> DataFrame:
    """Writes events in up to so many slots by time, and returns their schema as an empty frame; time becomes a timestamp.

    Slots are ranges of time that Spark deals out, each a file of its own in row groups of up to GROUP rows, which are read by a task each. With tick there is one more row at the end, ten years after the last, with nothing but its time:
    a watermark that follows it closes all windows and fires all timers.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if tick:
        last = rows.agg((F.max(time) + F.expr("INTERVAL 10 YEARS")).alias(time)).filter(F.col(time).isNotNull())
        rows = rows.unionByName(last, allowMissingColumns=True)
    rows.repartitionByRange(slots, time).sortWithinPartitions(time).write.option("parquet.block.row.count.limit", str(GROUP)).parquet(folder)
    return events.sparkSession.createDataFrame([], rows.schema)


class Slot(InputPartition):
    def __init__(self, file: str, group: int):
        super().__init__((file, group))
        self.file, self.group = file, group


class SlotReader(DataSourceStreamReader):
    """Reads the files of a folder by name, `step` of them a batch and up to `until` in all; a row group is a task."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.fieldNames()
        self.step, self.until, self.purge = int(options.get("step", "1")), int(options.get("until", "1000000000")), options.get("purge", "false") == "true"
        self.seen: int | None = None

    def _files(self) -> list[str]:
        """By slot: Spark numbers the files of a write by their partition."""
        fs, top = opened(self.path)
        names = [f.base_name for f in fs.get_file_info(pa.fs.FileSelector(top))]
        return sorted((n for n in names if re.match(r"part-\d+", n)), key=lambda n: int(re.match(r"part-(\d+)", n)[1]))

    def _numbers(self) -> dict[int, str]:
        return {int(re.match(r"part-(\d+)", n)[1]): n for n in self._files()}

    def initialOffset(self) -> dict:
        return {"slot": 0}

    def latestOffset(self) -> dict:
        """One step further at each call, so that a backlog comes in batches of bounded size."""
        end = min(max(self._numbers(), default=-1) + 1, self.until)
        self.seen = end if self.seen is not None and self.seen > end else min((self.seen or 0) + self.step, end)
        return {"slot": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Slot]:
        """Row groups of the slots from start up to end. After a restart the checkpoint has the offsets, and steps go on from there."""
        self.seen = max(self.seen or 0, end["slot"])
        fs, top = opened(self.path)
        numbers = self._numbers()
        names = [numbers[k] for k in range(start["slot"], end["slot"]) if k in numbers]
        return [Slot(n, g) for n in names for g in range(pq.ParquetFile(f"{top}/{n}", filesystem=fs).num_row_groups)]

    def read(self, partition: Slot) -> Iterator[pa.RecordBatch]:
        fs, top = opened(self.path)
        for b in pq.ParquetFile(f"{top}/{partition.file}", filesystem=fs).iter_batches(row_groups=[partition.group], columns=self.columns):
            columns = [c.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(c.type) else c for c in map(b.column, self.columns)]
            yield pa.RecordBatch.from_arrays(columns, self.columns)

    def commit(self, end: dict) -> None:
        if self.purge:
            fs, top = opened(self.path)
            for k, n in self._numbers().items():
                if k < end["slot"]:
                    fs.delete_file(f"{top}/{n}")


class Slots(DataSource):
    """spark.readStream.format("tidemark_slots").schema(...).option("path", folder): only the schema's columns are read. Options: step, until, purge."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_slots"

    def streamReader(self, schema: StructType) -> SlotReader:
        return SlotReader(dict(self.options), schema)


def stream(spark: SparkSession, folder: str, schema: StructType, **options: str) -> DataFrame:
    spark.dataSource.register(Slots)
    return spark.readStream.format("tidemark_slots").schema(schema).options(path=shared_uri(spark, folder), **options).load()
