"""Connected components by repeated contraction, all in Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import materialise


def _rank(c: str) -> Column:
    """Random but repeatable order of nodes: with it each round leaves a constant fraction of them, even on long chains."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root: a row for each node that has an edge.

    Every round hooks each node onto its smallest neighbour in the random order and contracts the edges to the
    hooks; self loops, repeated and reversed edges are allowed, no edges give no rows.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not rounds or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(
            both.groupBy(F.col("a").alias("node")).agg(F.min(_rank("b")).alias("best")).select("node", F.when(F.col("best") < _rank("node"), F.col("best.node")).otherwise(F.col("node")).alias("root"))
        )
        rounds.append(hooks)
        to_a, to_b = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        moved = left.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        left = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = rounds.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return found
