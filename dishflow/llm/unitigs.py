"""Compaction of nonbranching paths, by joins.

A node is a distinct path of repeated windows, and an edge leads from a path to one that follows it in a text. Where a
path has one successor in all its occurrences, and this has no other predecessor, the edge doesn't branch. Pointers
along such edges are doubled until each path knows the head of its chain and its distance from there; then a chain is
one path, which stands where its head does, and its other paths are dropped. A chain can't be a cycle: the last of its
occurrences in a text has no successor.

Keys are unique on both sides of each join but that of a path's occurrences with the path, whose inputs are plain
tables, so that Spark splits its large partitions. The rounds are as many as the logarithm of the longest chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import materialise


def heads(edges: DataFrame) -> DataFrame:
    """id, to, dist for edges (id, to: the only predecessor, dist) without branches: the chain's head, and its distance."""
    done: list[DataFrame] = []
    left = edges
    while True:
        known = reduce(DataFrame.unionByName, [*done, left]).select(F.col("id").alias("at"), F.col("to").alias("next"), F.col("dist").alias("more"))
        moved = left.join(known, F.col("to") == F.col("at"), "left")
        moved = materialise(moved.select("id", F.coalesce("next", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("open")))
        done.append(moved.where("not open").drop("open"))
        left = moved.where("open").drop("open")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)


def compacted(some: DataFrame, own: DataFrame, found: DataFrame, width: Column) -> DataFrame:
    """found (least, path, runs) with the nonbranching chains of wholly repeated paths at their heads. some: occurrences
    (least, path, t, start); own: paths with their number of occurrences n; width: a path's number of windows."""
    first = F.col("runs")[0]
    entire = (F.size("runs") == 1) & (first["from"] == 0) & (first["to"] == width)
    nodes = found.join(own.where("n > 1").select("least", "path", F.col("n").alias("times")), ["least", "path"]).where(entire)
    nodes = materialise(nodes.select("least", "path", "times", first.alias("run"), F.monotonically_increasing_id().alias("id")))

    # written first: a frequent path's occurrences are split over tasks
    places = materialise(some.join(nodes.select("least", "path", "times", "id"), ["least", "path"]).select("t", "start", (F.col("start") + width).alias("end"), "times", "id"))
    after = places.select(F.col("t").alias("row"), F.col("start").alias("place"), F.col("times").alias("times_2"), F.col("id").alias("id_2"))
    # a pair that comes as often as either path has no branch
    pairs = places.join(after, (F.col("t") == F.col("row")) & (F.col("end") == F.col("place")) & (F.col("times") == F.col("times_2")))
    pairs = pairs.groupBy("id", "id_2", "times").agg(F.count(F.lit(1)).alias("n")).where("n = times").select("id", "id_2")
    before = nodes.select("id", F.col("run.src").alias("src"), F.col("run.at").alias("at"), F.col("run.to").alias("size"))
    later = nodes.select(F.col("id").alias("id_2"), F.col("run.src").alias("src_2"), F.col("run.at").alias("at_2"))
    edges = pairs.join(before, "id").join(later, "id_2").where("src = src_2 and at + size = at_2")
    chains = heads(materialise(edges.select(F.col("id_2").alias("id"), F.col("id").alias("to"), F.col("size").cast("long").alias("dist"))))

    placed = nodes.select("least", "path", "id", "run").join(chains, "id", "left")
    reach = placed.groupBy(F.coalesce("to", "id").alias("head")).agg(F.max(F.coalesce("dist", F.lit(0)) + F.col("run.to")).cast("int").alias("reach"))
    longer = materialise(placed.where("to is null").join(reach, F.col("id") == F.col("head")).select("least", "path", F.array(F.col("run").withField("to", F.col("reach"))).alias("runs")))
    rest = found.join(nodes.select("least", "path"), ["least", "path"], "left_anti")
    return materialise(rest.unionByName(longer))
