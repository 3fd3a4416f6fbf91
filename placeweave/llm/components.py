"""Connected components of a link table, by alternating large-star and small-star steps.

Each round costs two aggregations over the links left; their lineage is cut by written tables. A
node with a large share of all links is then a skewed side of a plain shuffled join, which Spark
splits at run time.
No list of links or nodes ever reaches the driver, only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _star(links: DataFrame) -> DataFrame:
    """Large star, then small star: every node points to the least node it can see."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = common.materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # Small star: the lesser neighbours of a node, and the node, all point to the least of them.
    down = common.materialise(large.filter("a > b"), "down")
    lowest = common.materialise(down.groupBy("a").agg(F.min("b").alias("m")), "lowest")
    small = down.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a > b")
    return small.distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component, itself included) for every node of links (a, b).

    Loops and repeated links are fine, nulls are ignored; no links, no rows.
    """
    links = links.filter("a is not null and b is not null")
    now = common.materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    loops = now.filter("a = b").select("a", "b")
    now = now.filter("a > b")
    mark = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        now = common.materialise(_star(now), "links")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    every = tied.union(tied.select(F.col("root").alias("node"), "root")).union(loops.select(F.col("a").alias("node"), F.col("b").alias("root")))
    return every.groupBy("node").agg(F.min("root").alias("root"))
