"""Connected components of a graph given as edges, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with long ids -> ``node, component`` (the smallest id reachable) for every node with an edge.

    Each round points every node at the least neighbour it knows: first the
    greater neighbours of a node (large star), then the smaller ones (small
    star).  The rounds end when nothing moves; their number grows with the
    logarithm of the longest path.  Minima are pre-aggregated before the
    shuffle, and both they and the edges are in the shared folder when joined, so
    that a hot node's edges can be split; nothing but the count of changes comes to the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every edge now goes from greater u to smaller v
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        moved = cut(moved)
        changed = moved.join(now, ["u", "v"], "left_anti").limit(1).count() or now.join(moved, ["u", "v"], "left_anti").limit(1).count()
        now = moved
        if not changed:
            break
    nodes = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
