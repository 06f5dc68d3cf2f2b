"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.session import materialise


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    near = both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    tied = down.join(least, "u")
    pairs = tied.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
        least.select("u", F.col("least").alias("v"))
    )
    return pairs.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges between numbers -> (node, root): the least node that each node can reach.

    Only nodes with an edge are returned. Every step is two aggregates and joins, written to the shared
    folder; a node with very many neighbours is a skewed join, which adaptive execution splits. The steps end
    when a round leaves the edges as they are, after about the logarithm of the longest path.
    """
    state, before = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges"), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        state = materialise(small_star(large_star(state)), "edges")
