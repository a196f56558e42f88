"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import join_hot, materialize


#: Up to this many edges no hub is too large for a task.
FEW = 1_000_000


def _neighbours(pairs: DataFrame, few: bool) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and its neighbours. Hubs are not gathered in one task."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return pairs.join(least, "u") if few else join_hot(pairs, materialize(least, "least"), ["u"], "n")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Connect each node's larger neighbours to its smallest neighbour (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _neighbours(both, few).where("v > u AND m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Connect each node's smaller neighbours and itself to the smallest of them."""
    near = _neighbours(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), few)  # a < b
    ends = F.explode(F.array("v", "u")).alias("b")
    return near.select(F.col("m").alias("a"), ends).where("a < b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns a, b: long, any order, loops and repeats allowed).

    The component is the smallest node reachable. Each round is written to the shared folder and replaces the round
    before. The rounds grow with the logarithm of the longest path; more than ``max_rounds`` raise.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges, mark = materialize(edges, "edges"), None
    for _ in range(max_rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
        few = state[0] <= FEW
        large = _large_star(edges, few)
        edges = materialize(_small_star(large if few else materialize(large, "edges"), few), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
