"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step is a group minimum (combined map-side) and an equi join, so a node with very many
neighbours is only ever reduced, never gathered: minima are written before they are joined, so that
adaptive execution can split a hub's edges in the join. Edges are written to the shared folder after each
round. Nothing but one checksum row a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(materialize(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(materialize(low), "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(low.select("a", F.col("m").alias("b")))
        .filter("a <> b")
        .distinct()
    )


def _checksum(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).head()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, root): root is the least node of the component.

    Nodes without an edge are not returned; self loops and repeated edges are harmless.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        state = _checksum(now)
        if state["n"] == 0 or state == before:
            break
        before = state
        now = materialize(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
