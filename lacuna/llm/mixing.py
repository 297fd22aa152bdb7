"""Mixing sources to target weights by nested hash histograms.

Each document gets a 60-bit hash. A source's target is some whole passes over it plus a rest; the rest is the documents whose hash
is at most the source's cut. To find the cut, words are summed by source and the first 12 bits of the hash; the bucket in which the
running sum passes the rest is the boundary bucket, and only its documents are summed again, by the next 12 bits, five times in all.
The last bucket is a single hash value, taken if that comes nearer to the rest. Nothing is sorted but the at most 4096 buckets of a
source, and documents are chosen by a filter on their hash.

All of it is DataFrame expressions. Targets depend on all sources, so the table of sources, one row each, passes through one task. The sums combine before the shuffle, so a source with most of the rows is no hot key. The plan
has one row per source; Spark broadcasts it if its files are small, and otherwise joins by (source, hash prefix).

Defined cases: null or empty text has size 0; a null source is a source of its own, last in order; a null ``doc_id`` is hashed by
its text; rows with equal ids share a hash, so they are taken or left together; an empty table gives no rows; sources without words
have target 0. Reruns give the same rows, however the table is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

BITS, STEP = 60, 12


def hashed(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of MD5, which any SQL engine can repeat."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Documents without their texts: size in words and hash."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed().alias("h"))


def targets(docs: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: its size, target, whole passes and the rest of a pass.

    Targets are ``weight * level``, at most ``cap`` times the size. The level at which they use up the budget is the largest of
    (budget - caps of the sources before) / (weights of the others), with sources in the order in which they reach their caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("n", F.row_number().over(by_name))
    sources = sources.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    before = lambda c: F.coalesce(F.sum(c).over(by_cap), F.lit(0.0))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - before("most")) / (F.sum("weight").over(every) - before("weight"))
    sources = sources.withColumn("level", level).withColumn("target", F.least("most", F.col("weight") * F.max("level").over(every)))
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    return sources.select("source", "source_size", "target", passes.alias("passes")).withColumn(
        "rest", F.col("target") - F.col("passes") * F.col("source_size")
    )


def plan_mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """The sized documents, and per source the highest hash whose documents are taken once more (``cut``)."""
    docs = scratch.table(sized(docs), "sized")
    plan = scratch.table(targets(docs, weights, share, cap).withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long")}), "plan0")
    for level in range(1, BITS // STEP + 1):
        shift = BITS - STEP * level
        state = plan.select(F.col("source").alias("s"), "prefix", "below", "rest")
        rows = docs.withColumn("bucket", F.shiftright("h", shift)).withColumn("parent", F.shiftright("h", shift + STEP))
        if level == 1:  # one prefix: all documents are in it
            sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        else:
            known = state.select("s", "prefix")
            sums = rows.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("parent") == F.col("prefix"))).groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        state = state.drop("prefix")
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.join(state, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("below") + upto)
        # the first bucket past the rest; if none is, the last one
        past = F.when(F.col("upto") > F.col("rest"), F.lit(0)).otherwise(F.lit(1))
        place = F.struct(past.alias("past"), F.when(past == 0, F.col("bucket")).otherwise(-F.col("bucket")).alias("order"), "bucket", (F.col("upto") - F.col("words")).alias("below"), "upto")
        edge = sums.groupBy("source").agg(F.min(place).alias("edge")).select(F.col("source").alias("s"), "edge")
        plan = plan.drop("prefix", "below", "upto").join(edge, F.col("source").eqNullSafe(F.col("s")))
        plan = plan.select("source", "source_size", "target", "passes", "rest", F.col("edge.bucket").alias("prefix"), F.col("edge.below").alias("below"), F.col("edge.upto").alias("upto"))
        plan = scratch.table(plan, f"plan{level}")
    nearer = (F.col("upto") <= F.col("rest")) | ((F.col("below") < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")))
    return docs, plan.select("source", "source_size", "target", "passes", (F.col("prefix") - F.when(nearer, 0).otherwise(1)).alias("cut"))


def apply_mix(docs: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """Adds to documents with their hash ``h``: the source's size and target, and ``copies``, how often the mix takes each, ``cap`` times at most."""
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    copies = F.least(F.col("passes") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0), F.lit(math.ceil(cap)).cast("long"))
    return joined.withColumn("copies", copies).drop("plan_source", "passes", "cut")


def mix_sources(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: size, its source's size and target, copies, and the words that the mix takes of it.

    Sources in code point order take ``weights`` in turn and share ``share`` times all words; none gets more than ``cap`` times its own.
    """
    docs, plan = plan_mix(docs, scratch, weights, share, cap)
    return apply_mix(docs, plan, cap).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: every document, with all its columns, as often as the mix takes it."""
    _, plan = plan_mix(docs, scratch, weights, share, cap)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "source", hashed().alias("h"))
    taken = apply_mix(whole, plan, cap).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return taken.select("row.*")


#: The same in DuckDB: documents in hash order, taken while the running sum comes nearer to the rest.
SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
    SELECT *, ([5.0, 2.0, 1.0])[((n - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s
), l AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM w WINDOW b AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM l
), p AS (
    SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS passes FROM t
), c AS (
    SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
           sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN upto <= rest OR (upto - tied < rest AND upto - rest < rest - (upto - tied)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
