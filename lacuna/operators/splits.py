"""Leakage-safe splits. Every draw is an order expression, so a split is the same however the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import draw, unit_draw


def hash_order(seed: int, *columns: str) -> Column:
    """The usual order of a draw."""
    return draw(seed, *columns)


def qualifying_branches(meta: DataFrame, branch: str = "genus", least: int = 5, only: list[str] | None = None) -> DataFrame:
    """(branch, n): branches with ``least`` entities or more."""
    sizes = meta.filter(F.col(branch).isNotNull()).groupBy(F.col(branch).alias("branch")).agg(F.countDistinct("entity").alias("n")).filter(F.col("n") >= least)
    return sizes.filter(F.col("branch").isin(only)) if only else sizes


def split_by_branch(cells: DataFrame, branches: DataFrame, frac: float, order: Column, eval_share: float = 0.8) -> DataFrame:
    """(branch, entity, feature, part) for all branches in one plan. ``cells`` carries its own ``branch``.

    Outside the branch all cells train. Inside, each entity's features are put in ``order``: the first ceil(share * n) are for
    evaluation, the next min(round(n * frac), rest) train too, the others are unused. Cells outside are not listed per branch: join
    ``cells`` with ``branch <> ...`` or use ``train_outside``.
    """
    inside = cells.join(branches.select("branch"), "branch")
    by = Window.partitionBy("branch", "entity")
    n, place = F.count("*").over(by), F.row_number().over(by.orderBy(order, "feature"))
    tested = F.ceil(F.round(F.col("n") * eval_share, 9))
    train = F.least(F.bround(F.col("n") * frac), F.col("n") - tested)
    part = F.when(F.col("place") <= tested, "eval").when(F.col("place") <= tested + train, "train").otherwise("unused")
    return inside.withColumn("n", n).withColumn("place", place).select("branch", "entity", "feature", "value", part.alias("part"))


def stratified_holdout(rows: DataFrame, stratum: str, order: Column, frac: float = 0.2) -> DataFrame:
    """Adds ``part``: of each stratum max(1, floor(n * frac)) rows are the test."""
    by = Window.partitionBy(stratum)
    n, place = F.count("*").over(by), F.row_number().over(by.orderBy(order))
    test = F.greatest(F.lit(1), F.floor(F.round(n * frac, 9)))
    return rows.withColumn("part", F.when(place <= test, "test").otherwise("train"))


def group_holdout(rows: DataFrame, group: str, min_test: int = 1, min_train: int = 5) -> DataFrame:
    """(fold, entity, part): one fold per group, if both sides are large enough."""
    sizes = rows.groupBy(F.col(group).alias("fold")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(F.lit(0))
    folds = sizes.withColumn("all", F.sum("n").over(total)).filter((F.col("n") >= min_test) & (F.col("all") - F.col("n") >= min_train)).select("fold")
    return rows.crossJoin(folds).select("fold", "entity", F.when(F.col(group) == F.col("fold"), "test").otherwise("train").alias("part"))


def value_holdout(cells: DataFrame, held: DataFrame) -> DataFrame:
    """(entity, part): entities that hold any of the values ``held`` (feature, value) are the test."""
    hit = cells.join(held, ["feature", "value"], "left_semi").select("entity").distinct().withColumn("part", F.lit("test"))
    return cells.select("entity").distinct().join(hit, "entity", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def context_target_halves(cells: DataFrame, order: Column, least: int = 4) -> DataFrame:
    """Adds ``half``: of each entity with ``least`` features, the first floor(n / 2) are context, the others target."""
    by = Window.partitionBy("entity")
    rows = cells.withColumn("n", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy(order, "feature")))
    half = F.when(F.col("place") <= F.floor(F.col("n") / 2), "context").otherwise("target")
    return rows.filter(F.col("n") >= least).withColumn("half", half).drop("n", "place")


def random_blanking(cells: DataFrame, reps: int = 5, low: float = 0.3, high: float = 0.7, seed: int = 42) -> DataFrame:
    """(rep, entity, feature, value, blanked): in each repetition each entity has a share of its features blanked."""
    each = cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    by = Window.partitionBy("rep", "entity")
    place = F.row_number().over(by.orderBy(draw(seed + 1, "rep", "entity", "feature"), "feature"))
    blanks = F.floor(F.count("*").over(by) * (F.lit(low) + unit_draw(seed, "rep", "entity") * (high - low)))
    return each.select("rep", "entity", "feature", "value", (place <= blanks).alias("blanked"))


def random_val_fraction(rows: DataFrame, frac: float, order: Column) -> DataFrame:
    """Adds ``part``: the share ``frac`` of all rows, lowest in ``order``, is for validation. The cut is a quantile, so nothing is sorted
    in one place."""
    ordered = rows.withColumn("_o", order)
    cut = ordered.agg(F.percentile("_o", F.lit(frac)).alias("_c"))
    return ordered.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col("_o") < F.col("_c"), "val").otherwise("train")).drop("_o", "_c")


def group_kfold(rows: DataFrame, group: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: all rows of a group are in one fold."""
    return rows.withColumn("fold", F.pmod(draw(seed, group), F.lit(folds)).cast("int"))
