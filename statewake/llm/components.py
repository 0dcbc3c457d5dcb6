"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewake.llm.common import Scratch, spread_join


def _large_star(edges: DataFrame, n: int, most: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("degree"))
    moved = spread_join(both.where("b > a"), least, ["a"], "degree", 2 * n, most)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    moved = spread_join(down, least, ["a"], "degree", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int, bool]:
    """Edges, the most at one node, and whether all are stars around their smallest nodes: no larger end has two edges or is a smaller end too."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    n, most, loose = nodes.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.count_if(F.expr("up > 1 or up = 1 and down > 0"))).first()
    return n or 0, most or 0, not loose


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node and component (the smallest node reachable) of every node with an edge; edges(a, b) are integers.

    Each half of a round is written to the shared folder; the loop ends when all edges are stars, which
    takes a logarithmic number of rounds, none where they are stars at once. Nodes with many edges are joined by
    broadcast (see spread_join), so that no task gets all edges of one.
    """
    now, k = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-0"), 0
    while True:
        n, most, stars = _state(now)
        if stars:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        k += 1
        half = scratch.write(_large_star(now, n, most), f"{label}-{k}-large")
        scratch.drop(f"{label}-{k - 1}")
        # the large star has at most an edge for each of those before and its reverse
        now = scratch.write(_small_star(half, 2 * n), f"{label}-{k}")
        scratch.drop(f"{label}-{k}-large")
