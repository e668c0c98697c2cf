"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.operators import scale


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long): root is the smallest node that it reaches.

    In each round the larger neighbours of every node are linked to its smallest neighbour, then its smaller ones, until nothing
    changes. Distances shrink by a factor a round, so a chain of any length takes few of them. A node's
    neighbours are never gathered, only their minimum.
    """
    edges = scale.settle(links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        up = both.join(least, "a").filter("b >= a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = up.groupBy("a").agg(F.min("b").alias("low"))
        down = up.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = scale.settle(down.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "stars")
        last, mark = mark, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
