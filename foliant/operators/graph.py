"""Components of small proposal graphs by alternating star contractions; each round is two aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.shared import Workspace, is_empty


def star_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """``(node, component)`` of an edge list ``(src, dst)``; ``component`` is the smallest node.

    A large star links every greater neighbour of a node to the node's smallest neighbour, a small star every smaller
    one; the edges become stars around the smallest nodes after a number of rounds logarithmic in the component size.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst")
    now = space.keep(clean.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(small_least, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        following = space.keep(small)
        if is_empty(following.exceptAll(now)) and is_empty(now.exceptAll(following)):
            break
        space.drop(now)
        now = following
    inner = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return inner.unionByName(tops)
