"""Connected components of an undirected graph by alternating stars.

Large-star points every larger neighbour of a node at the node's smallest
neighbour; small-star does so for the smaller neighbours.  Each keeps the
components, and the edges converge to one star per component in a number of
rounds that grows with the logarithm of the longest path.  Edges never outgrow
the input, each round is two equi-joins with partial aggregation before the
shuffle, and its result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.plans.scratch import materialize


def _table(least: DataFrame) -> DataFrame:
    """A table of its own: only then can a join split a large star's rows over tasks."""
    return materialize(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _table(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node with an edge to another.

    Self-loops, repeated edges, either direction and null ends are allowed;
    nodes without an edge to another node have no row.
    """
    a, b = F.col(left), F.col(right)
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        now = materialize(_small_star(_large_star(now)), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
