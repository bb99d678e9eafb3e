"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept, removed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b); label is the smallest node of the component.

    Alternates two steps until the edges stay the same: every node sends its larger
    neighbours to its smallest one, then its smaller ones. Each step is an aggregation
    by node and a join, so a node with many neighbours is spread like any other rows.
    """
    now = kept(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph")
    state = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Larger neighbours (and the node itself) of each node go to its smallest neighbour.
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # Smaller neighbours of each node, and the node, go to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()
        new = kept(small, "graph")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        removed(now.sparkSession, now)
        now = new
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
