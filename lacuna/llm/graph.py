"""Connected components of a graph whose edges are rows, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """``edges`` (a, b) of comparable ids -> (node, root): the smallest id that each linked node reaches; roots themselves have no row.

    A large-star step ties every larger neighbour of a node to its smallest neighbour, a small-star step every smaller one; they
    end when all edges point at roots. The minima combine before the shuffle; joins are plain joins, so that adaptive execution
    splits the partition of a node with very many edges. Every step is written to shared storage.
    """
    ends = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    stars, before, step = scratch.table(ends(edges), f"{name}0"), None, 0
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(ends(large), f"{name}large{step}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = scratch.table(ends(small), f"{name}{step + 1}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{step}", f"{name}large{step}")
        stars, step = after, step + 1
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
