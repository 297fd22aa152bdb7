"""Preparation of long tables of cells (entity, feature, value), their metadata, and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.climb import chains


def resolve_column(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Selects one column per wanted name: the first alias that the table has, whatever its case; null where it has none."""
    have = {c.strip().lower(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), F.lit(None).cast("string"))
    return df.select(*(pick([name, *names]).alias(name) for name, names in aliases.items()))


def label_values(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Adds ``label``: the code's name, else ``value_<raw>``. ``values`` has code and value, ``codes`` code and name."""
    return values.join(codes.select("code", F.col("name").alias("label")), "code", "left").withColumn(
        "label", F.coalesce("label", F.concat(F.lit("value_"), "value"))
    )


def drop_uncertain(cells: DataFrame, column: str = "value") -> DataFrame:
    """Leaves out null, blank and "?" values and labels that say that nothing is known. Comes before any pivot."""
    plain = F.lower(F.regexp_replace(F.trim(column), r"\s+", " "))
    return cells.filter(F.col(column).isNotNull() & ~plain.isin("", "?", "not known", "uncertain", "not applicable"))


def first_value_per_cell(cells: DataFrame, order: str) -> DataFrame:
    """One row per (entity, feature): the first non-null value in ``order``."""
    return cells.filter("value is not null").groupBy("entity", "feature").agg(F.min_by("value", order).alias("value"))


def attach_meta(cells: DataFrame, meta: DataFrame, *order: str) -> DataFrame:
    """Inner join with the first metadata row of each entity; later columns of the order settle ties of the earlier ones. Rows without a value of the first don't count; entities that have no others get nulls."""
    kept = [c for c in meta.columns if c not in ("entity", *order)]
    first = meta.groupBy("entity").agg(F.min_by(F.struct(*kept), F.when(F.col(order[0]).isNotNull(), F.struct(*order))).alias("_m"))
    return cells.join(first.select("entity", "_m.*"), "entity")


def min_features_per_entity(cells: DataFrame, n: int = 10) -> DataFrame:
    """Only entities with ``n`` observed features or more."""
    rich = cells.groupBy("entity").agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select("entity")
    return cells.join(rich, "entity", "left_semi")


def null_rare_values(cells: DataFrame, n: int = 10) -> DataFrame:
    """Leaves out values that fewer than ``n`` entities hold. Comes after ``min_features_per_entity``, which is not repeated."""
    common = cells.groupBy("feature", "value").agg(F.countDistinct("entity").alias("_n")).filter(F.col("_n") >= n)
    return cells.join(common.select("feature", "value"), ["feature", "value"], "left_semi").select(*cells.columns)


def feature_catalogue(cells: DataFrame) -> DataFrame:
    """Features that have a value left, with the number of their values and cells."""
    return cells.groupBy("feature").agg(F.countDistinct("value").alias("n_values"), F.count("*").alias("n_cells"))


def classification_level(path: str, level: int = 2) -> Column:
    """The node at ``level`` of a path divided by slashes, blank nodes ignored; else the deepest node; null if there is none."""
    nodes = F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.try_element_at(nodes, F.greatest(F.least(F.lit(level + 1), F.size(nodes)), F.lit(1)))


def ancestor_path(tree: DataFrame) -> DataFrame:
    """(id, name, parent) -> (id, path, depth): names from the root down to the node. A node met again ends the climb, so every climb ends."""
    nodes = tree.select("id", F.col("parent").alias("up"), F.struct("id", "name").alias("node"))
    names = F.reverse(F.transform("chain", lambda x: x["name"]))
    return chains(nodes).select("id", F.array_join(names, "/").alias("path"), (F.size("chain") - 1).alias("depth"))


def genus_map(meta: DataFrame, tree: DataFrame | None = None, level: int = 2) -> DataFrame:
    """Adds ``genus`` by the best source there is: a classification path, the ancestors in ``tree``, or the family; the family
    also fills gaps. Entities that still have none are dropped."""
    if "classification" in meta.columns:
        found = meta.withColumn("genus", classification_level("classification", level))
    elif tree is not None:
        paths = ancestor_path(tree).select(F.col("id").alias("entity"), "path")
        found = meta.join(paths, "entity", "left").withColumn("genus", classification_level("path", level)).drop("path")
    else:
        found = meta.withColumn("genus", F.col("family"))
    return found.withColumn("genus", F.coalesce("genus", "family")).filter("genus is not null")


def clean_verses(text: str) -> Column:
    """Verse lines joined by spaces: blank and ``<range>`` lines go, and what stands before the first tab of a line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "<range>"))
    return F.array_join(F.transform(lines, lambda x: F.when(F.instr(x, "\t") > 0, F.trim(F.element_at(F.split(x, "\t", 2), 2))).otherwise(x)), " ")


def token_count(text: str) -> Column:
    """Tokens between white space; an empty text has none."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.coalesce(plain, F.lit("")) == "", 0).otherwise(F.size(F.split(plain, " ")))


def min_tokens(texts: DataFrame, n: int = 50_000) -> DataFrame:
    return texts.withColumn("n_tokens", token_count("text")).filter(F.col("n_tokens") >= n)


def script_fraction(text: str, least: float = 0.8, letters: int = 20, chars: int = 5000) -> Column:
    """Whether Latin, Cyrillic or Greek makes up ``least`` of the letters at the start; false with fewer than ``letters``."""
    start = F.substring(text, 1, chars)
    all_ = F.length(F.regexp_replace(start, r"[^\p{L}]", ""))
    known = F.length(F.regexp_replace(start, r"[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]", ""))
    return (all_ >= letters) & (known >= least * all_)


def longest_per_key(texts: DataFrame, key: str, order: str) -> DataFrame:
    """The text with most tokens of each key, the first in ``order`` on ties."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n_tokens").desc(), order))
    return texts.withColumn("_n", n).filter("_n = 1").drop("_n")


def merge_corpora(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The longer text of each key; ties keep ``a``. Adds ``corpus``."""
    both = a.withColumn("corpus", F.lit("a")).unionByName(b.withColumn("corpus", F.lit("b")))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.length("text").desc(), "corpus"))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n")


def iso_from_filename(name: str) -> Column:
    """Two or three letters at the start of a file's stem, else the stem in lower case."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""))
    code = F.regexp_extract(stem, "^([a-z]{2,3})", 1)
    return F.when(code != "", code).otherwise(stem)


def cap_first_n(rows: DataFrame, n: int, order: str, *keys: str) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def match_entities(left: DataFrame, ids: DataFrame, manual: DataFrame) -> DataFrame:
    """Best match of each (code, iso) among ``ids`` (id): a manual pair (code, id), the ISO code, the code, its first three letters.

    Cases do not matter. Each step is an equality join; of several ids that are the same in lower case the smallest counts.
    """
    known = ids.groupBy(F.lower("id").alias("_k")).agg(F.min("id").alias("_id"))
    own = manual.groupBy(F.lower("code").alias("_c")).agg(F.min("id").alias("manual"))
    out = left.join(own, F.lower("code") == F.col("_c"), "left").drop("_c")
    for name, key in (("by_iso", F.lower("iso")), ("by_code", F.lower("code")), ("by_prefix", F.lower(F.substring("code", 1, 3)))):
        out = out.join(known.withColumnRenamed("_id", name), key == F.col("_k"), "left").drop("_k")
    how = F.when(F.col("manual").isNotNull(), "manual").when(F.col("by_iso").isNotNull(), "iso").when(F.col("by_code").isNotNull(), "code")
    return out.select("code", F.coalesce("manual", "by_iso", "by_code", "by_prefix").alias("id"), how.when(F.col("by_prefix").isNotNull(), "prefix").alias("how"))


def align_vectors(entities: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """One row per entity with its vector; a zero vector and ``found = false`` where there is none."""
    joined = entities.join(vectors.select("entity", "vec"), "entity", "left")
    return joined.select("entity", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("vec"), F.col("vec").isNotNull().alias("found"))


def char_vocab(texts: DataFrame, min_freq: int = 5, most: int = 500, chars: int = 500_000) -> DataFrame:
    """(ch, freq, idx): the commonest characters of the texts' starts, ids from 2 (0 pads, 1 is unknown)."""
    counts = texts.select(F.explode(F.split(F.substring("text", 1, chars), "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("freq"))
    n = F.row_number().over(Window.orderBy(F.col("freq").desc(), "ch"))
    return counts.orderBy(F.col("freq").desc(), "ch").limit(most).filter(F.col("freq") >= min_freq).withColumn("idx", n + 1)


def max_majority_filter(bin_cells: DataFrame, most: float) -> DataFrame:
    """Features whose binary columns are, on average, no more one-sided than ``most``: (feature, majority)."""
    columns = bin_cells.groupBy("feature", "bin_col").agg(F.avg("bit").alias("m"))
    return columns.groupBy("feature").agg(F.avg(F.greatest("m", 1 - F.col("m"))).alias("majority")).filter(F.col("majority") <= most)


def shared_entities(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("entity").intersect(b.select("entity"))


def native_to_standard_id(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-keys cells by the mapping (entity, standard); blank targets and unmapped entities are left out, the native id is kept."""
    known = mapping.filter(F.trim("standard") != "")
    return cells.join(known, "entity").withColumnRenamed("entity", "native").withColumnRenamed("standard", "entity")


def lookup_with_default(rows: DataFrame, table: DataFrame, key: str, column: str, default: str) -> DataFrame:
    return rows.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def size_counts(tokens: DataFrame, *keys: str) -> DataFrame:
    """Sentences and tokens by key."""
    return tokens.groupBy(*keys).agg(F.countDistinct("sent").alias("n_sentences"), F.count("*").alias("n_tokens"))
