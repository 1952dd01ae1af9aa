"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

Each text is cut into chunks where its own content says so. A chunk's identifier is its digest,
after a check over all chunks that no two different contents share that digest. A document is
then the ordered list of its chunks' identifiers, and only these lists are grouped and joined:
a long text itself moves once at most, as chunks, and equal chunks of a task move together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_IDS, first_of_repeats, text_of, without, written

#: A chunk has 1,024 to 8,192 characters and ends after a blank that follows one of these characters.
CHUNK = r"(?s).{1024,8192}?(?<=[dgkpy.,]\s)|.{1,8192}"


def sha256_id(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def ambiguous_digests(docs: DataFrame, text: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that chunks of different content share (with SHA-256: none).

    The contents meet in an aggregate with a map-side part, so that each task sends a frequent chunk once.
    """
    chunks = docs.select(F.explode(chunks_of(text)).alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk")
    seen = chunks.groupBy("digest").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return seen.filter("lo <> hi").select("digest")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] = sha256_id) -> DataFrame:
    """(id, text_sha256, recipe): recipe is the list of the identifiers of the text's chunks.

    A chunk whose digest is ambiguous is identified by its content. A null text counts as empty; an empty text has an empty list.
    """
    text = normalise(text_of(text_col)) if normalise else text_of(text_col)
    odd = written(ambiguous_digests(docs, text, digest), "ambiguous")
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    named = base.select("id", F.sha2("t", 256).alias("text_sha256"), F.transform(chunks_of(F.col("t")), digest).alias("recipe"))
    if odd.isEmpty():
        return named
    parts = base.select("id", "t", F.posexplode(chunks_of(F.col("t"))).alias("pos", "chunk")).withColumn("digest", digest(F.col("chunk")))
    parts = parts.join(odd.withColumn("odd", F.lit(True)), "digest", "left")
    own = F.when(F.col("odd"), F.encode("chunk", "utf-8")).otherwise(F.col("digest"))
    lists = parts.groupBy("id", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", own.alias("c")))), lambda x: x["c"]).alias("recipe"))
    again = named.select(F.col("id"), "text_sha256").distinct()
    some = lists.select("id", F.sha2("t", 256).alias("text_sha256"), "recipe")
    return (
        base.select("id", F.sha2("t", 256).alias("text_sha256"))
        .join(again, ["id", "text_sha256"], "left_semi")
        .join(some, ["id", "text_sha256"], "left")
        .withColumn("recipe", F.coalesce("recipe", F.array().cast("array<binary>")))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] = sha256_id) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest id stays. Null texts count as empty. Rows repeated with
    the same id all get that id; a null id never stays unless its whole group has none. Other columns of docs don't matter.
    """
    rows = recipes(docs, id_col, text_col, normalise, digest)
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    both = rows.join(written(groups, "groups"), "recipe", "left")  # a table of its own, so that Spark splits the copies of a large group
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return both.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each text: that of the largest id. Of repeated rows with that id and text, one stays, rather one whose text isn't null.

    Rows under one id, or under none, are told apart by their text, so that each of their texts is kept. All others go or stay by
    their id alone, and their texts aren't moved.
    """
    judged = exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), "text_sha256", "kept")
    judged = written(judged, "judged")
    several = written(judged.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id"), "several")
    gone = judged.filter("NOT kept AND id IS NOT NULL").select("id").union(several).distinct()
    plain = without(docs.filter(F.col(id_col).isNotNull()), gone, id_col)
    alike = judged.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "id", "left_semi").union(judged.filter("id IS NULL"))
    if alike.isEmpty():
        return plain
    pair = lambda sha, i: F.concat_ws("/", sha, F.col(i).cast("string")).alias("__tidemark_pair")
    kept = written(alike.filter("kept").select(pair(F.col("text_sha256"), "id")).distinct(), "kept")
    rows = docs.join(several.select(F.col("id").alias("__tidemark_id")), F.col(id_col) == F.col("__tidemark_id"), "left_semi").union(docs.filter(F.col(id_col).isNull()))
    rows = rows.select("*", pair(F.sha2(text_of(text_col), 256), id_col)).join(kept, "__tidemark_pair", "left_semi").select(*docs.columns, "__tidemark_pair")
    return plain.union(first_of_repeats(rows, "__tidemark_pair", F.col(text_col).isNull()).drop("__tidemark_pair"))
