"""Connected components of a graph given as links, by alternating stars: each step is a minimum and a join by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orarium.llm.common import discard, written


def star(links: DataFrame, large: bool) -> DataFrame:
    """u, v with v < u -> the same components with links nearer to the smallest node.

    Large star: what is above a node goes to the node's smallest neighbour; small star: so does what is below."""
    sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = sides.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def is_forest(links: DataFrame) -> bool:
    """Whether every link goes straight to its component's smallest node: no node has two links up, or links both ways."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()


def stars(links: DataFrame, name: str = "components") -> DataFrame:
    """u, v (longs, in any order) -> u, v: each node but its component's smallest, with that one."""
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    while not is_forest(now):
        before, now = now, written(star(star(now, large=True), large=False), name)
        discard(before)
    return now


def labels(forest: DataFrame) -> DataFrame:
    """node, component of the nodes in a forest of stars."""
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(forest.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(links: DataFrame) -> DataFrame:
    """u, v -> node, component (the smallest node reachable), for the nodes that have a link."""
    return labels(stars(links))
