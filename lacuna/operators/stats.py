"""Statistics of cells: marginals, co-occurrence, IDF, mutual information, log confidence.

Co-occurrence is the one quadratic step (features of an entity squared). It joins on the entity with ``fi < fj``, combines before the
shuffle, and is mirrored only after aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import entropy_term


def marginal_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("feature", "value").agg(F.count("*").alias("n"))


def marginals(counts: DataFrame, book: DataFrame, smooth: float = 0.5) -> DataFrame:
    """(feature, value, p): smoothed over the values of the codebook."""
    joined = book.select("feature", "value").join(counts, ["feature", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + smooth)
    return joined.select("feature", "value", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("p"))


def cooccurrence(cells: DataFrame, mirror: bool = True) -> DataFrame:
    """(fi, vi, fj, vj, n): entities that hold both values, for ordered pairs of different features."""
    a = cells.select("entity", F.col("feature").alias("fi"), F.col("value").alias("vi"))
    b = cells.select("entity", F.col("feature").alias("fj"), F.col("value").alias("vj"))
    half = a.join(b, "entity").filter("fi < fj").groupBy("fi", "vi", "fj", "vj").agg(F.count("*").alias("n"))
    if not mirror:
        return half
    return half.union(half.select(F.col("fj").alias("fi"), F.col("vj").alias("vi"), F.col("fi").alias("fj"), F.col("vi").alias("vj"), "n"))


def n_entities(cells: DataFrame) -> DataFrame:
    """One row: the number of entities."""
    return cells.agg(F.countDistinct("entity").alias("n_all"))


def idf(cells: DataFrame) -> DataFrame:
    """(feature, idf): ln(N / (1 + entities with the feature)); may be negative."""
    seen = cells.groupBy("feature").agg(F.countDistinct("entity").alias("n"))
    return seen.crossJoin(F.broadcast(n_entities(cells))).select("feature", F.ln(F.col("n_all") / (1 + F.col("n"))).alias("idf"))


def mutual_information(cells: DataFrame, book: DataFrame, min_count: int = 5) -> DataFrame:
    """(fi, fj, mi) for fi < fj: sum of p ln(p / (p_i p_j)) with p over all entities, clipped at 0.

    Values of the lower feature need ``min_count`` entities; the marginals are smoothed.
    """
    counts = marginal_counts(cells)
    p = marginals(counts, book)
    pi = p.join(counts.filter(F.col("n") >= min_count).drop("n"), ["feature", "value"]).select(F.col("feature").alias("fi"), F.col("value").alias("vi"), F.col("p").alias("pi"))
    pj = p.select(F.col("feature").alias("fj"), F.col("value").alias("vj"), F.col("p").alias("pj"))
    joint = cooccurrence(cells, mirror=False).crossJoin(F.broadcast(n_entities(cells))).withColumn("pij", F.col("n") / F.col("n_all"))
    terms = joint.join(pi, ["fi", "vi"]).join(pj, ["fj", "vj"])
    term = F.col("pij") * F.ln(F.col("pij") / (F.col("pi") * F.col("pj")))
    return terms.groupBy("fi", "fj").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("mi"))


def feature_entropy(p: DataFrame) -> DataFrame:
    return p.groupBy("feature").agg(F.sum(entropy_term(F.col("p"))).alias("h"))


def nmi(mi: DataFrame, entropy: DataFrame) -> DataFrame:
    """(fi, fj, nmi): mi / (h_i + h_j), 0 if the sum vanishes."""
    h = lambda f, to: entropy.select(F.col("feature").alias(f), F.col("h").alias(to))
    joined = mi.join(h("fi", "hi"), "fi").join(h("fj", "hj"), "fj")
    total = F.col("hi") + F.col("hj")
    return joined.select("fi", "fj", F.when(total <= 1e-10, 0.0).otherwise(F.try_divide(F.col("mi"), total)).alias("nmi"))


def source_target_counts(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, sv, target, tv, n_joint, n_st, n_v, n_f): counts at all grains, for sources other than the target itself.

    ``n_st`` is the number of entities with that source value and any value of the target, ``n_v`` and ``n_f`` count the target's
    value and its cells.
    """
    s = sources.select("entity", F.col("feature").alias("source"), F.col("value").alias("sv"))
    t = targets.select("entity", F.col("feature").alias("target"), F.col("value").alias("tv"))
    joint = s.join(t, "entity").filter("source <> target").groupBy("source", "sv", "target", "tv").agg(F.count("*").alias("n_joint"))
    joint = joint.withColumn("n_st", F.sum("n_joint").over(Window.partitionBy("source", "sv", "target")))
    single = t.groupBy("target", "tv").agg(F.count("*").alias("n_v")).withColumn("n_f", F.sum("n_v").over(Window.partitionBy("target")))
    return joint.join(single, ["target", "tv"]).select("source", "sv", "target", "tv", "n_joint", "n_st", "n_v", "n_f")


def log_confidence(counts: DataFrame, book: DataFrame, alpha: float = 0.5, min_src: int = 2) -> DataFrame:
    """(source, sv, target, tv, n_st, score) for every value of the target's codebook; pairs never seen count 0 together."""
    pairs = counts.select("source", "sv", "target", "n_st", "n_f").distinct().filter(F.col("n_st") >= min_src)
    values = book.select(F.col("feature").alias("target"), F.col("value").alias("tv"), "k")
    single = counts.select("target", "tv", "n_v").distinct()
    rows = pairs.join(values, "target").join(counts.select("source", "sv", "target", "tv", "n_joint"), ["source", "sv", "target", "tv"], "left").join(single, ["target", "tv"], "left")
    joint, alone = F.coalesce("n_joint", F.lit(0)), F.coalesce("n_v", F.lit(0))
    score = F.ln((joint + alpha) / (F.col("n_st") + alpha * F.col("k"))) - F.ln((alone + alpha) / (F.col("n_f") + alpha * F.col("k")))
    return rows.select("source", "sv", "target", "tv", "n_st", score.alias("score"))


def conditional_table(cells: DataFrame, book: DataFrame, least: int = 10, cell: int = 5) -> DataFrame:
    """(fi, vi, fj, vj, p): P(vj given vi) where both values have ``least`` entities; uniform if a seen pair of the row has fewer than ``cell``."""
    counts = marginal_counts(cells).filter(F.col("n") >= least).drop("n")
    both = cooccurrence(cells).join(counts.toDF("fi", "vi"), ["fi", "vi"]).join(counts.toDF("fj", "vj"), ["fj", "vj"])
    row = Window.partitionBy("fi", "vi", "fj")
    share = F.when(F.min("n").over(row) < cell, 1 / F.count("*").over(row)).otherwise(F.col("n") / F.sum("n").over(row))
    return both.select("fi", "vi", "fj", "vj", share.alias("p"))
