"""Connected components of a graph of links, as tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import staged


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) long. Returns (id, component) with the smallest id reachable, for every id in a link.

    Large-star and small-star in turn until nothing changes: rounds grow with the logarithm of the
    longest path. A star's partial minima are taken before the shuffle, so a hub with a
    third of all links costs a row for each task; null ends take no part, an empty table gives an empty result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written tables on this side leave both sides of the joins plain shuffles, so that a hub's share is split.
        low = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        # Large star: a node's larger neighbours go to its smallest neighbour.
        large = edges.select(F.col("b").alias("n"), F.col("a").alias("x")).join(low.withColumnRenamed("a", "n"), "n").select(F.col("x").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "large-star")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = staged(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        # Done when every node has one neighbour, which is a root.
        open_ = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a").union(after.join(after.select(F.col("b").alias("r")).distinct(), F.col("a") == F.col("r"), "left_semi").select("a"))
        done = not open_.take(1)
        edges = after
        if done:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
