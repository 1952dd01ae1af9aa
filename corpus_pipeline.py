"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before it kept. All but the last return the columns of documents, others that are there too.
Empty tables give empty ones. A null text counts as an empty one and stays null where its row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, minhash, packing, suffixes, toxicity
from tidemark.llm.shared import table, text_of, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, doesn't reject. Each row is judged by its text alone: repeated rows and rows without an id as any, null and empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest id; one without an id only if no copy has one. Repeated rows become one, texts that share an id are each kept."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, that of the smallest id. Rows without an id or whose id has several texts stay, as do texts without words."""
    return minhash.drop_near_duplicates(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; their texts without strings that start in a document of smaller id, n_chars as it then is.

    Texts go by doc_id and digest, which the stages before have left unique together; rows without an id keep their text.
    """
    kept = suffixes.without_repeats(docs.filter("doc_id IS NOT NULL")).toDF("__tidemark_id", "__tidemark_sha", "__tidemark_text")
    same = (docs["doc_id"] == kept["__tidemark_id"]) & (F.sha2(text_of(), 256) == kept["__tidemark_sha"])
    rows = docs.join(kept, same, "left")
    text = F.when(F.col("text").isNotNull() & F.col("doc_id").isNotNull(), F.col("__tidemark_text")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Repeated rows are packed each, an empty or null text as its end alone, a null id as the least one."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_strings),
    ("packing", pack),
]

#: Stages 1, 3, 4 and 5 can't be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
