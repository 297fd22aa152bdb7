"""Chains of ancestors in tables of nodes, by doubling: as many steps as the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scratch import written


def chains(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, id, chain) of nodes (keys, id, up, node): each node's ``node`` (a struct with the id first), then its parent's and so on.

    In every step a chain takes over the chain of the node above its end, which is as long as its own. A parent that is not there ends the
    climb, and so does a node that was met before.
    """
    every, step = written(nodes.select(*keys, "id", "up", F.array("node").alias("chain")), "chains0"), 0
    while not every.filter("up IS NOT NULL").isEmpty():
        above = every.select(*keys, F.col("id").alias("up"), F.col("up").alias("_up"), F.col("chain").alias("_chain"))
        joined = every.join(above, [*keys, "up"], "left")
        both = F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(F.concat("chain", "_chain"))
        once = F.array_distinct(F.col("_both"))
        grown = joined.withColumn("_both", both).select(*keys, "id", F.when(F.size(once) == F.size("_both"), F.col("_up")).alias("up"), once.alias("chain"))
        step += 1
        every = written(grown, f"chains{step}")
    return every.select(*keys, "id", "chain")
