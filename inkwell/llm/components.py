"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _STAGED, join_skewed, remove_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of edges (a, b: long).

    Each step stays in tables: no node's neighbours are gathered anywhere, and hubs are dealt out. It ends once every
    node points to the smallest of its component.
    """
    spark, since = edges.sparkSession, len(_STAGED)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, seen = staged(edges, "edges"), None
    while True:
        total = edges.count()
        state = edges.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]
        if not total or (total, state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = total, state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_skewed(both, least, "a", 2 * total, "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_skewed(large, least, "a", total, "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        remove_staged(spark, since, (edges,))  # earlier rounds
