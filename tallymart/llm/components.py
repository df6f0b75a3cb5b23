"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.staging import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: those above it; else: those below it and the node itself) move to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (u, v long); a component is its least node.

    Nodes without an edge, loops aside, do not appear; repeated edges do not
    matter; no edges give no rows. Each round is written to the shared folder,
    and only two numbers a round come to the driver. Rounds grow with the
    logarithm of the number of nodes.
    """
    now = stage(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        after = stage(_star(_star(now, large=True), large=False), "stars")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now = after
        if seen == tuple(state):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = tuple(state)
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
