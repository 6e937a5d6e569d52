"""Connected components by alternating stars, on tables written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import materialise, release


def _nearest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the smallest neighbour m of u, and the table of m to release.

    The minima are written first and joined by sorting at any size, so that Spark can split the rows of a hub.
    """
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least.hint("merge"), "u"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); the root is the smallest node reached.

    Large-star links each node's larger neighbours to its smallest neighbour, small-star links the smaller
    ones; repeated until nothing changes, in rounds about the logarithm of the longest path. Each round
    writes its edges, never more than there were. Loops and repeated edges do no harm.
    """
    order = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = materialise(order)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, least = _nearest(both)
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        release(least)
        near, least = _nearest(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        small = materialise(small.distinct())
        same = small.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(small, ["u", "v"], "left_anti").isEmpty()
        release(now, large, least)
        now = small
        if same:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
