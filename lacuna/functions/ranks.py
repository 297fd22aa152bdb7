"""Ranks over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scratch import written


def ranked(rows: DataFrame, value: str, *keys: str, name: str = "rank") -> DataFrame:
    """Adds the rank of each row's value within its keys, from 1; ties share the mean of their ranks, nulls come first.

    Equal values are counted first, so a tie is one row. The different values are dealt into ranges, numbered inside their range, and moved up by the sizes of the ranges
    before, of which there are as many as tasks.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = written(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "rank-values")
    sizes = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_part", "_t"))).alias("_s"))
    before = F.transform("_s", lambda s, i: F.struct(s["_part"].alias("_part"), F.aggregate(F.slice("_s", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + x["_t"]).alias("_b")))
    starts = sizes.select(*keys, F.inline(before))
    inside = F.sum("_c").over(Window.partitionBy("_part", *keys).orderBy(value)) - F.col("_c")
    ranks = placed.withColumn("_i", inside).join(starts, [*keys, "_part"])
    ranks = ranks.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate((*keys, value))), (F.col("_b") + F.col("_i") + (F.col("_c") + 1) / 2).alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate((*keys, value))]
    return rows.join(ranks, same).select(*rows.columns, name)
