"""Connected components by label propagation over stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of edges (a, b): component is the smallest id that can be reached.

    Alternates two steps until nothing changes: each node links its larger neighbours to its least
    one, then its smaller neighbours and itself to its least one. A node's neighbours never meet in
    one task: least ones come from an aggregate and are a table of their own, so that Spark splits the join of a node with
    very many neighbours. Every round is written to the shared folder.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
