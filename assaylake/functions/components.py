"""Connected components by alternating large-star and small-star rounds, all joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scratch import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the smallest of those (edges hold u > v)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(low.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one centre and no centre hangs on another: nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("centre").alias("centre")).where("hangs > 1 OR (hangs = 1 AND centre = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); component is the smallest node it reaches.

    Null ends and self loops carry no link and are ignored; repeated edges count once. A node without an edge
    is not in the result. Each round is a written table, so lineage stays flat; the number of rounds grows with
    the logarithm of the longest path. A star's centre may be one hot key: it is pre-aggregated before its
    shuffle and the join back to it is one that adaptive execution may split.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = written(e, "edges")
    for _ in range(max_rounds):
        turned = written(_small_star(_large_star(now)), "edges")
        drop(now)
        now = turned
        if _is_stars(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    low = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(low)
