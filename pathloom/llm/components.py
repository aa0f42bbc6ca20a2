"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import materialize

MAX_ROUNDS = 40


def _stars(edges: DataFrame) -> DataFrame:
    """Every node's neighbours, itself included, and the least of them."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written out, so that the join below can split a node with very many neighbours.
    least = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), "least")
    return both.join(least, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): its component is the smallest node that it reaches.

    Large-star and small-star steps in turn, until no edge changes; the number of rounds grows with the
    logarithm of the number of nodes. Nothing is collected but one checksum a round.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    checksum = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = checksum(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # Large star: larger neighbours go to the least neighbour.
        large = _stars(current).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of them; edges point down (a > b).
        least = materialize(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = large.join(least, "a").select(F.col("b").alias("x"), "least").where("x <> least").unionByName(
            least.select(F.col("a").alias("x"), "least")
        )
        current = materialize(small.select(F.col("x").alias("a"), F.col("least").alias("b")).distinct(), "edges")
        after = checksum(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

