"""Connected components by alternating large-star and small-star rounds on written edge tables.

A hub with a third of all links is no hot key: the few nodes of many links are joined by broadcast (join_spread), and all
minima are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, join_spread, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", F.least("a", "least").alias("least"), "n")
    return join_spread(both.filter("b > a"), least, "a", 2 * n).select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
    moved = join_spread(down, least, "a", n).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link: root is the smallest node of its component.

    edges: (a, b), of any order, repeats and loops allowed, further columns ignored, nulls link nothing. Each round is written
    to the shared folder; only a count and a checksum of it reach the driver. No links: no rows. Rounds go on until none
    changes anything.
    """
    held, path = written(edges.select("a", "b").filter("a <> b").distinct(), "links")
    spark, seen, n = edges.sparkSession, None, held.count()
    while n:
        stars, stars_path = written(_large_star(held, n), "links")
        after, next_path = written(_small_star(stars, n), "links")
        for old in (path, stars_path):
            drop_path(spark, old)
        held, path = after, next_path
        mark = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen, n = mark, mark[0]
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(held.select(F.col("b"), F.col("b")).distinct())
