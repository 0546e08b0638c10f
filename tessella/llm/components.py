"""Connected components by alternating stars, each step two aggregations and joins of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.session import shared_dir


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the least of them."""
    hung = edges.join(_least(edges), "u")
    return hung.select("u", F.col("m").alias("v")).union(hung.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, parts: int) -> DataFrame:
    """node, component (its least node) for every node of the undirected ``edges`` (a, b), numbers; loops count for nothing.

    ``parts``: in how many partitions the edges are kept between steps; small graphs make few files.
    """
    shared_dir(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(parts).checkpoint()
    seen = None
    while True:
        now = _small_star(_large_star(now)).coalesce(parts).checkpoint()
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
