"""Lists that are read page by page, as from a server that gives out so many rows at a time and may say beforehand how many there are.

A list is a folder of Parquet files in the list's order, a row group a page. Its plan, a table of the pages with their sizes and least and greatest values, is
what the first answer's total is to a server's list: with it all pages are read at the same time, a task each (of a long list: a task for a run of them), and
those that a filter can't need aren't read. Without it one task walks the pages one after another until there are no more.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark.sources.shared import opened, shared_uri

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Tasks that read a list, at most: of more pages each reads a run.
TASKS = 256
PLAN = "file string, page int, n long, bounds map<string, struct<lo: string, hi: string, numeric: boolean>>"


def lay_out(rows: DataFrame, folder: str, order: list[str], size: int, planned: bool = True) -> None:
    """Writes rows in order as pages of size rows, and their plan. Files are ranges of the order; a page never spans two."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", str(size)).option("parquet.page.row.count.limit", str(size)).parquet(f"{folder}/pages")
    if planned:
        plan(rows.sparkSession, folder).write.parquet(f"{folder}/plan")


def plan(spark: SparkSession, folder: str) -> DataFrame:
    """PLAN rows of a list's pages, from the files' footers; a task reads those of some files."""
    at = shared_uri(spark, f"{folder}/pages")
    fs, top = opened(at)
    names = sorted(f.base_name for f in fs.get_file_info(pa.fs.FileSelector(top)) if f.base_name.endswith(".parquet"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(at)
        for b in batches:
            rows = []
            for name in b["file"].to_pylist():
                meta = pq.ParquetFile(f"{top}/{name}", filesystem=fs).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    stats = {(c := group.column(k)).path_in_schema: c.statistics for k in range(group.num_columns)}
                    bounds = {p: {"lo": str(s.min), "hi": str(s.max), "numeric": isinstance(s.min, int | float)} for p, s in stats.items() if s is not None and s.has_min_max and isinstance(s.min, int | float | str)}
                    rows.append((name, g, group.num_rows, list(bounds.items())))
            kinds = pa.schema([("file", pa.string()), ("page", pa.int32()), ("n", pa.int64()), ("bounds", pa.map_(pa.string(), pa.struct([("lo", pa.string()), ("hi", pa.string()), ("numeric", pa.bool_())])))])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), 256)))
    return files.mapInArrow(read, PLAN)


class Run(InputPartition):
    """Pages (file, number) that a task reads, or without any all of them in turn."""

    def __init__(self, pages: list[tuple[str, int]]):
        super().__init__(pages)
        self.pages = pages


def _value(text: str, numeric: bool):
    return (int(text) if text.lstrip("-").isdigit() else float(text)) if numeric else text


def may_hold(bounds: dict, f: Filter) -> bool:
    """Whether a page with these bounds of its columns may have rows that pass a filter."""
    b = bounds.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    if b is None:
        return True
    lo, hi = _value(b["lo"], b["numeric"]), _value(b["hi"], b["numeric"])
    wanted = f.value
    if any(isinstance(w, str) == b["numeric"] for w in (wanted if isinstance(f, In) else [wanted])):
        return True
    if isinstance(f, EqualTo):
        return lo <= wanted <= hi
    if isinstance(f, In):
        return any(lo <= w <= hi for w in wanted)
    if isinstance(f, GreaterThan | GreaterThanOrEqual):
        return hi > wanted or hi == wanted and isinstance(f, GreaterThanOrEqual)
    if isinstance(f, LessThan | LessThanOrEqual):
        return lo < wanted or lo == wanted and isinstance(f, LessThanOrEqual)
    return True


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns, self.filters = options["path"], schema.fieldNames(), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters choose pages here; rows are still Spark's to filter."""
        self.filters = [f for f in filters if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)]
        yield from filters

    def partitions(self) -> list[Run]:
        fs, top = opened(self.path)
        if fs.get_file_info(f"{top}/plan").type == pa.fs.FileType.NotFound:
            return [Run([])]
        plan = pa.dataset.dataset(f"{top}/plan", filesystem=fs, format="parquet")
        batches = plan.to_batches(columns=["file", "page", "bounds"] if self.filters else ["file", "page"])
        pages = sorted((p["file"], p["page"]) for b in batches for p in b.to_pylist() if not self.filters or all(may_hold(dict(p["bounds"]), f) for f in self.filters))
        each = -(-len(pages) // TASKS)
        return [Run(pages[k : k + each]) for k in range(0, len(pages), max(1, each))]

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one task where there are no pages
            return
        fs, top = opened(self.path)
        if partition.pages:
            for file, pages in itertools.groupby(partition.pages, key=lambda p: p[0]):
                yield from pq.ParquetFile(f"{top}/pages/{file}", filesystem=fs).iter_batches(row_groups=[n for _, n in pages], columns=self.columns)
            return
        for f in sorted(fs.get_file_info(pa.fs.FileSelector(f"{top}/pages")), key=lambda f: f.base_name):
            if f.base_name.endswith(".parquet"):
                whole = pq.ParquetFile(f.path, filesystem=fs)
                for g in range(whole.num_row_groups):
                    yield from whole.iter_batches(row_groups=[g], columns=self.columns)


class Pages(DataSource):
    """spark.read.format("tidemark_pages").schema(...).load(folder): only the schema's columns are read."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options), schema)


def listed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A list's rows. Spark's setting for filters in Python sources is turned on, where the session doesn't set it: it is read when a plan is made."""
    spark.dataSource.register(Pages)
    if spark.conf.get(PUSHDOWN, None) in (None, "false"):
        spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("tidemark_pages").schema(schema).load(shared_uri(spark, folder))


def changes_since(spark: SparkSession, folder: str, schema: StructType, since: int, state: str = "state") -> DataFrame | None:
    """The changes (id, op: 0 created, 1 updated, 2 destroyed; state) of a paged log whose state is over since, read page by page; None if the log
    doesn't reach back to since any more, and all has to be listed anew."""
    oldest = spark.read.schema(PLAN).parquet(f"{folder}/plan").agg(F.min(F.col("bounds")[state]["lo"].cast("long"))).first()[0]
    if oldest is not None and oldest > since + 1:
        return None
    return listed(spark, folder, schema).filter(F.col(state) > since)
