"""Coding of categorical cells: value catalogues, binary columns, observed profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scratch import written


def codebook(cells: DataFrame, least: int = 2) -> DataFrame:
    """(feature, fi, value, vi, gid, k): features with ``least`` values or more, values in order, local and global numbers from 0."""
    by = Window.partitionBy("feature")
    known = cells.filter("value is not null").select("feature", "value").distinct()
    known = known.withColumn("vi", F.row_number().over(by.orderBy("value")) - 1).withColumn("k", F.count("*").over(by).cast("int")).filter(F.col("k") >= least)
    return known.withColumn("fi", F.dense_rank().over(Window.orderBy("feature")) - 1).withColumn("gid", F.row_number().over(Window.orderBy("feature", "value")) - 1)


def encode(cells: DataFrame, book: DataFrame) -> DataFrame:
    """(entity, fi, vi) by an existing codebook; unknown values are missing, that is left out."""
    return cells.join(book.select("feature", "value", "fi", "vi"), ["feature", "value"]).select("entity", "fi", "vi")


def observed_triples(cells: DataFrame, book: DataFrame) -> DataFrame:
    """(entity, gid): all observed cells by global value number."""
    return cells.join(book.select("feature", "value", "gid"), ["feature", "value"]).select("entity", "gid")


def bin_catalog(book: DataFrame) -> DataFrame:
    """(feature, bin_col, pos, pos_value, neg_value, n_vals): one column for two values, the second of them 1; else one per value."""
    two = book.filter("k = 2").groupBy("feature").agg(F.max("value").alias("pos_value"), F.min("value").alias("neg_value"), F.first("k").alias("n_vals"), F.lit(0).alias("pos"))
    more = book.filter("k > 2").select("feature", F.col("value").alias("pos_value"), F.lit(None).cast("string").alias("neg_value"), F.col("k").alias("n_vals"), F.col("vi").alias("pos"))
    both = two.unionByName(more)
    return both.withColumn("bin_col", F.row_number().over(Window.orderBy("feature", "pos")) - 1).select("feature", "bin_col", "pos", "pos_value", "neg_value", "n_vals")


def binarise(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """(entity, feature, bin_col, bit) of every observed cell of a catalogued feature."""
    joined = cells.join(catalog.select("feature", "bin_col", "pos_value"), "feature")
    return joined.select("entity", "feature", "bin_col", (F.col("value") == F.col("pos_value")).cast("int").alias("bit"))


def metadata_as_features(cells: DataFrame, meta: DataFrame, *columns: str) -> DataFrame:
    """Cells and, as features of their own, metadata columns where they are not null."""
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    extra = meta.selectExpr("entity", f"stack({len(columns)}, {pairs}) as (feature, value)").filter("value is not null")
    return cells.select("entity", "feature", "value").unionByName(extra)


def geo_clusters(meta: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(entity, cluster): k-means over latitude and longitude; entities without a place have none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    placed = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="place", handleInvalid="skip").transform(meta)
    return KMeans(k=k, seed=seed, featuresCol="place", predictionCol="cluster").fit(placed).transform(placed).select("entity", "cluster")


def observed_profiles(cells: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(fv, feature, entity, present): true for the value held, false for the other values of a feature that is observed.

    Features with one value give no false rows; an entity that holds two values has both. Rows of values are made where the entity's cells are, from a written list of values,
    and are not grouped.
    """
    if shared is not None:
        cells = cells.join(shared.select("entity"), "entity", "left_semi")
    values = written(cells.filter("feature is not null").select("feature", F.col("value").alias("any_value")).distinct(), "profile-values")
    held = cells.groupBy("entity", "feature").agg(F.collect_set("value").alias("held"))
    present = F.when(F.col("any_value").isNotNull() & (F.size("held") > 0), F.array_contains("held", F.col("any_value")))
    return held.join(values, "feature").select(value_label("feature", "any_value").alias("fv"), "feature", "entity", present.alias("present"))


def enumerated_profiles(cells: DataFrame, values: list[str], order: str) -> DataFrame:
    """The same over a fixed list of values, where the first observation of a cell counts."""
    first = cells.filter("value is not null").groupBy("entity", "feature").agg(F.min_by("value", order).alias("value"))
    each = F.explode(F.array(*(F.lit(v) for v in values))).alias("any_value")
    return first.select("entity", "feature", "value", each).select(
        value_label("feature", "any_value").alias("fv"), "feature", "entity", (F.col("value") == F.col("any_value")).alias("present")
    )


def value_label(feature: str, value: str) -> Column:
    return F.concat_ws("=", feature, value)


def feature_id_of(labels: DataFrame, known: DataFrame) -> DataFrame:
    """(label, target): the label itself if it is known, the bare feature for ``=1``, null otherwise."""
    known = known.select(F.col("label").alias("_k"), F.lit(True).alias("_y"))
    whole = labels.join(known.withColumnRenamed("_y", "exact"), F.col("label") == F.col("_k"), "left").drop("_k")
    bare = F.when(F.col("label").endswith("=1"), F.substring_index("label", "=", 1))
    both = whole.withColumn("bare", bare).join(known.withColumnRenamed("_y", "by_feature"), F.col("bare") == F.col("_k"), "left").drop("_k")
    return both.select("label", F.when(F.col("exact"), F.col("label")).when(F.col("by_feature"), F.col("bare")).alias("target"))
