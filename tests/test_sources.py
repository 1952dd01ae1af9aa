"""Paged lists, message files and bucketed tables: what is read and written, not only what comes out."""

import uuid

import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from tidemark.operators import buckets
from tidemark.sources import maildir, pages
from tidemark.sources.shared import opened, shared_dir, shared_uri


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"


def test_pages_that_no_filter_needs_are_not_read(spark, folder):
    rows = spark.range(10_000).select(F.col("id"), F.concat(F.lit("b"), F.lpad(F.floor(F.col("id") / 1000).cast("string"), 2, "0")).alias("box"))
    pages.lay_out(rows, folder, ["id"], 100)
    table = pages.listed(spark, folder, rows.schema)
    tasks = lambda df: df.rdd.getNumPartitions()
    plan = spark.read.parquet(f"{folder}/plan").collect()
    assert sum(p["n"] for p in plan) == 10_000 and max(p["n"] for p in plan) == 100
    assert tasks(table) == len(plan) and table.count() == 10_000
    one = table.filter("id = 4321")
    assert (tasks(one), [r["id"] for r in one.collect()]) == (1, [4321])
    some = table.filter("id IN (5, 9990) AND box <> 'x'")
    assert (tasks(some), some.count()) == (2, 2)
    box = table.filter("box = 'b03' AND id >= 3500")
    assert tasks(box) <= 7 and box.count() == 500
    none = table.filter("id > 20000")
    assert tasks(none) <= 1 and none.count() == 0


def test_long_lists_are_read_by_a_bounded_number_of_tasks(spark, folder):
    rows = spark.range(6000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    pages.lay_out(rows, folder, ["id"], 10)
    table = pages.listed(spark, folder, rows.schema)
    assert spark.read.parquet(f"{folder}/plan").count() > 2 * pages.TASKS and table.rdd.getNumPartitions() <= pages.TASKS
    assert sorted(map(tuple, table.collect())) == [(k, k % 7) for k in range(6000)]
    some = table.filter("id >= 5990")
    assert some.rdd.getNumPartitions() <= 2 and some.count() == 10


def test_pages_without_a_plan_are_walked_by_one_task(spark, folder):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    pages.lay_out(rows, folder, ["id"], 50, planned=False)
    table = pages.listed(spark, folder, rows.schema)
    assert table.rdd.getNumPartitions() == 1 and table.filter("v = 3").count() == rows.filter("v = 3").count()


def test_bounds():
    b = {"n": {"lo": "-3", "hi": "7", "numeric": True}, "s": {"lo": "b", "hi": "d", "numeric": False}}
    yes = [EqualTo(("n",), 7), In(("n",), (99, 0)), GreaterThan(("n",), 6), GreaterThanOrEqual(("n",), 7), LessThan(("n",), -2), LessThanOrEqual(("n",), -3), EqualTo(("s",), "c"), EqualTo(("x",), 1), EqualTo(("n",), "text"), EqualTo(("n", "m"), 99)]
    no = [EqualTo(("n",), 8), In(("n",), (99, -4)), GreaterThan(("n",), 7), GreaterThanOrEqual(("n",), 8), LessThan(("n",), -3), LessThanOrEqual(("n",), -4), EqualTo(("s",), "e")]
    assert all(pages.may_hold(b, f) for f in yes) and not any(pages.may_hold(b, f) for f in no)


def test_changes_since(spark, folder):
    log = spark.range(10, 1000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("op"), F.col("id").alias("state"))
    pages.lay_out(log, folder, ["state"], 40)
    late = pages.changes_since(spark, folder, log.schema, 950)
    assert sorted(r["id"] for r in late.collect()) == list(range(951, 1000)) and late.rdd.getNumPartitions() <= 3
    assert pages.changes_since(spark, folder, log.schema, 9).count() == 990
    assert pages.changes_since(spark, folder, log.schema, 5) is None  # the log begins after that state


def test_files_are_scanned_by_name_alone(spark, folder):
    data = [("a", "cur", "1", "FS", "m1", "x"), ("a", "new", "2", "", "m2", None), ("a/b c+d", "cur", "3", "", "m3", "é\r\n\r\nMessage-ID: <no>"), ("a", "cur", "7", "S", "", "")]
    n = maildir.deliver(spark.createDataFrame(data, "folder string, subdir string, maildir_id string, flags string, message_id string, body string"), folder)
    files = maildir.scanned(spark, folder)
    assert n == 4 and {tuple(r)[:4] for r in files.drop("header").collect()} == {r[:4] for r in data}
    assert {r["maildir_id"]: r["m"] for r in files.select("maildir_id", maildir.message_id(F.col("header")).alias("m")).collect()} == {"1": "m1", "2": "m2", "3": "m3", "7": None}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan(files) and "content" not in plan(files.drop("header"))


def test_headers_of_bodies_in_any_code(spark, folder):
    """The bytes that are read for a header end within a character of the first body; the second isn't UTF-8 at all."""
    bodies = [("1", "é" * maildir.HEADER), ("2", "x" + "é" * maildir.HEADER)]
    maildir.deliver(spark.createDataFrame([("a", "new", k, "", "m" + k, b) for k, b in bodies], "folder string, subdir string, maildir_id string, flags string, message_id string, body string"), folder)
    fs, top = opened(shared_uri(spark, folder))
    with fs.open_output_stream(f"{top}/a/new/3") as out:
        out.write(b"Message-ID: <m3>\n\n\xff\xfe")
    files = maildir.scanned(spark, folder)
    assert {r["maildir_id"]: r["m"] for r in files.select("maildir_id", maildir.message_id(F.col("header")).alias("m")).collect()} == {"1": "m1", "2": "m2", "3": "m3"}


def test_files_are_listed_by_tasks(spark, folder):
    """As many tasks as there are folders or cores, not one for so many files; a root without messages has none."""
    rows = spark.range(3000).select(F.lit("a/b").alias("folder"), F.lit("new").alias("subdir"), F.col("id").cast("string").alias("maildir_id"), F.lit("").alias("flags"), F.col("id").cast("string").alias("message_id"), F.lit("x").alias("body"))
    maildir.deliver(rows, folder)
    names = maildir.scanned(spark, folder).drop("header")
    assert names.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and names.count() == 3000
    assert maildir.scanned(spark, f"{folder}/none").count() == 0


def test_upsert_rewrites_touched_buckets_alone(spark, folder):
    rows = spark.range(1000).select("id", F.lit("old").alias("v"), F.lit(None).cast("string").alias("w"))
    buckets.create(rows, folder, "id", 16)

    def files() -> dict[str, set[str]]:
        fs, top = opened(shared_uri(spark, folder))
        found: dict[str, set[str]] = {}
        for f in fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True)):
            if f.base_name.endswith(".parquet"):
                found.setdefault(f.path.split("bucket=")[1].split("/")[0], set()).add(f.base_name)
        return found

    before = files()
    new = spark.createDataFrame([(5, "new", "x"), (2000, "new", "y")], rows.schema)
    touched = buckets.upsert(spark, folder, new, "id", gone=spark.createDataFrame([(7,)], "id long"), buckets=16)
    after = files()
    assert 1 <= len(touched) <= 3 and all((before[b] == after[b]) == (int(b) not in touched) for b in before)
    got = {r["id"]: (r["v"], r["w"]) for r in buckets.read(spark, folder, rows).collect()}
    assert got == {**{k: ("old", None) for k in range(1000) if k != 7}, 5: ("new", "x"), 2000: ("new", "y")}
    assert buckets.upsert(spark, folder, new.filter("false"), "id", buckets=16) == []
    whole = buckets.read(spark, folder, rows).filter(F.col("bucket") == touched[0]).select("id")
    buckets.upsert(spark, folder, new.filter("false"), "id", gone=whole, buckets=16)
    assert buckets.read(spark, folder, rows).filter(F.col("bucket") == touched[0]).count() == 0
    assert buckets.read(spark, folder, rows).count() > 800


def test_failed_changes_keep_their_rows(spark):
    planned = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(r["k"] for r in buckets.outcomes(planned, spark.createDataFrame([(2,), (2,)], "k int"), "k").collect()) == [1, 3]
