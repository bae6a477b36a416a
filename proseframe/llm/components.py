"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest id of its component.

    Ids are longs; links of a node with itself and null ends say nothing. Each round hangs every
    neighbour that is larger than a node below the smallest one around it, then does the same for
    the smaller ones, until every link leads from a node to a root that has no smaller neighbour.
    Rounds grow with the logarithm of the number of nodes. Each half round is a written table, so
    no lineage piles up. Hubs are handled by partial minima and by joins whose large partitions can
    be split.
    """
    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges = written(down(links), "links")
    while True:
        # small star: the smaller neighbours of a node, and the node, below the smallest of them
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        small = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = written(down(small), "small-stars")
        # a node with a smaller neighbour that is no root, or with two of them, is not settled yet
        is_root = F.col("a").isNull()
        tops = edges.select(F.col("b").alias("root")).distinct().join(edges.select("a").distinct(), F.col("root") == F.col("a"), "left")
        counts = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        inner = tops.where(~is_root).limit(1)
        if counts.first()["most"] <= 1 and inner.isEmpty():
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
        # large star: the larger neighbours of a node below the smallest one around it
        both = edges.select("a", "b").union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(down(large), "large-stars")
