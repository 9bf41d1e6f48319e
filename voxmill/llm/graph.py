"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a minimum per node (combined before the shuffle) and a join, whose
skewed side Spark can split, so a node with very many neighbours is no problem.
Edges are rewritten to a table in the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that is not the smallest of its component.

    ``edges`` has one row per link, in either direction, repeated or not; null
    ends and links of a node to itself are ignored.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now, "links")
    while True:
        again = now.groupBy("u").count().where("count > 1").select("u")
        if now.join(now.select(F.col("u").alias("v")), "v", "left_semi").select("u").unionByName(again).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, now = now, written(_small_star(_large_star(now)), "links")
        drop_written(before)
