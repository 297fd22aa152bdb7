"""Association between features of two databases over shared entities, ranking of candidates, and retrieval scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import cosine, dot
from lacuna.functions.scratch import written
from lacuna.operators.coding import value_label

Kernel = Callable[[Column, Column, Column, Column], Column]


#: Entities of a chunk on average, and of a word of its bitmaps.
CHUNK, WORD = 1024, 64


def bitmaps(profile: DataFrame, numbers: DataFrame) -> DataFrame:
    """(chunk, fv, observed, present): one row per value and chunk of entities, with the two sets as lists of 64-bit words. ``numbers`` is (entity, chunk, number)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % WORD).cast("int"))
    words = profile.join(numbers.hint("shuffle_hash"), "entity").withColumn("word", F.floor(F.col("number") / WORD).cast("int")).groupBy("chunk", "fv", "word")
    words = words.agg(F.bit_or(bit).alias("o"), F.bit_or(F.when(F.col("present"), bit).otherwise(F.lit(0).cast("long"))).alias("p"))
    by_word = words.groupBy("chunk", "fv").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("o", "p")))).alias("words"))
    filled = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("words"))), lambda w: F.try_element_at("words", w))
    pick = lambda part: F.transform(filled, lambda w: F.coalesce(w[part], F.lit(0).cast("long")))
    return by_word.select("chunk", "fv", pick("o").alias("observed"), pick("p").alias("present"))


def shared_bits(a: str, b: str) -> Column:
    """How many bits two lists of words have in common; the shorter one ends with zeros."""
    both = F.zip_with(a, b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseAND(y)).cast("long"), F.lit(0).cast("long")))
    return F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x)


def numbered_entities(a: DataFrame, b: DataFrame, chunk: int) -> DataFrame:
    """(entity, chunk, number): the entities that both profiles have, dealt into chunks by hash and numbered inside."""
    shared = written(a.select("entity").distinct().join(b.select("entity").distinct(), "entity", "left_semi"), "shared-entities")
    n_chunks = max(1, -(-shared.count() // chunk))
    dealt = shared.withColumn("chunk", F.pmod(F.xxhash64("entity"), F.lit(n_chunks)).cast("int"))
    return dealt.withColumn("number", F.row_number().over(Window.partitionBy("chunk").orderBy("entity")) - 1)


def contingency(a: DataFrame, b: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(fv_a, fv_b, n11, n10, n01, n00) over entities that both profiles (fv, entity, present) observe. Filter queries first.

    Values are bitmaps over chunks of entities, and the counts are bits of intersections: what is joined is one row per value and chunk, and values that are observed in no
    common chunk are never paired.
    """
    numbers = written(numbered_entities(a, b, chunk), "entity-numbers")
    x, y = (bitmaps(p, numbers).select("chunk", F.col("fv").alias(f"fv_{n}"), F.col("observed").alias(f"o_{n}"), F.col("present").alias(f"p_{n}")) for p, n in ((a, "a"), (b, "b")))
    pairs = x.join(y, "chunk").select("fv_a", "fv_b", shared_bits("o_a", "o_b").alias("n"), shared_bits("p_a", "p_b").alias("n11"), shared_bits("p_a", "o_b").alias("na"), shared_bits("o_a", "p_b").alias("nb"))
    sums = pairs.filter("n > 0").groupBy("fv_a", "fv_b").agg(*(F.sum(c).alias(c) for c in ("n", "n11", "na", "nb")))
    return sums.selectExpr("fv_a", "fv_b", "n11", "na - n11 AS n10", "nb - n11 AS n01", "n - na - nb + n11 AS n00")


def contingency_of_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same from cells (entity, feature, value), where a feature that is observed observes all its values: those of ``a`` in shared entities, all of ``b``.

    An entity gives a row for each pair of its values, one of them or both replaced by null for 'any'; tasks add them up, so what moves is a row for each pair of values.
    """
    each = lambda n: F.explode_outer(F.array_union("items", F.transform("items", lambda x: F.struct(x["feature"].alias("feature"), F.lit(None).cast("string").alias("value"))))).alias(n)
    whole = lambda df: df.filter("feature IS NOT NULL AND value IS NOT NULL").groupBy("entity").agg(F.collect_set(F.struct("feature", F.col("value").cast("string").alias("value"))).alias("items"))
    both = whole(b).select("entity", each("b")).join(whole(a), "entity", "left").select("b", each("a"))
    keys = {"fa": F.col("a.feature"), "va": F.col("a.value"), "fb": F.col("b.feature"), "vb": F.col("b.value")}
    counts = written(both.groupBy(*(e.alias(n) for n, e in keys.items())).agg(F.count("*").alias("n")), "pair-counts")
    some = lambda x, y, name: counts.filter(f"va IS {x} NULL AND vb IS {y} NULL AND fa IS NOT NULL").withColumnRenamed("n", name)
    values = lambda f, v: counts.filter(f"{v} IS NOT NULL").select(f, v).distinct()
    table = some("", "", "n").select("fa", "fb", "n").join(values("fa", "va"), "fa").join(values("fb", "vb"), "fb")
    for keep, x, y, name in ((("fa", "va", "fb"), "NOT", "", "na"), (("fa", "fb", "vb"), "", "NOT", "nb"), (("fa", "va", "fb", "vb"), "NOT", "NOT", "n11")):
        table = table.join(some(x, y, name).select(*keep, name), list(keep), "left")
    table = table.fillna(0, ["na", "nb", "n11"])
    return table.select(value_label("fa", "va").alias("fv_a"), value_label("fb", "vb").alias("fv_b"), "n11", F.expr("na - n11").alias("n10"), F.expr("nb - n11").alias("n01"), F.expr("n - na - nb + n11").alias("n00"))


def k_cosine(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    return F.coalesce(F.try_divide(n11.cast("double"), F.sqrt((n11 + n10) * (n11 + n01))), F.lit(0.0))


def k_phi(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    size = F.sqrt((n11 + n10).cast("double") * (n01 + n00) * (n11 + n01) * (n10 + n00))
    return F.coalesce(F.try_divide((n11 * n00 - n10 * n01).cast("double"), size), F.lit(0.0))


def k_jaccard(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    return F.coalesce(F.try_divide(n11.cast("double"), n11 + n10 + n01), F.lit(0.0))


def k_ppmi(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    n = n11 + n10 + n01 + n00
    ratio = F.try_divide(n11 * n.cast("double"), (n11 + n10) * (n11 + n01))
    return F.when(ratio > 0, F.greatest(F.lit(0.0), F.ln(ratio))).otherwise(F.lit(0.0))


def k_log_odds(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    return F.ln((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5)))


KERNELS: dict[str, Kernel] = {"cosine": k_cosine, "phi": k_phi, "jaccard": k_jaccard, "ppmi": k_ppmi, "log_odds": k_log_odds}


def apply_kernel(table: DataFrame, kernel: Kernel, least: int = 5) -> DataFrame:
    """(fv_a, fv_b, score) of pairs with ``least`` shared entities."""
    cells = [F.col(c) for c in ("n11", "n10", "n01", "n00")]
    return table.filter(sum(cells[1:], cells[0]) >= least).select("fv_a", "fv_b", kernel(*cells).alias("score"))


def rank_candidates(table: DataFrame, queries: DataFrame, candidates: DataFrame, kernel: Kernel, least: int = 10, sentinel: float = -2.0) -> DataFrame:
    """(fv_a, fv_b, score) of every query with every candidate; too few observations give the sentinel. Queries are a stated set."""
    grid = queries.select("fv_a").crossJoin(candidates.select("fv_b"))
    return grid.join(apply_kernel(table, kernel, least), ["fv_a", "fv_b"], "left").withColumn("score", F.coalesce("score", F.lit(sentinel)))


def predicted_profiles(entities: DataFrame, values: DataFrame, lam: float = 1.0) -> DataFrame:
    """(entity, feature, value, p): softmax over a feature's values of the inner product of entity and value vectors."""
    rows = entities.select("entity", F.col("vec").alias("_e")).crossJoin(values.select("feature", "value", F.col("vec").alias("_v")))
    rows = rows.select("entity", "feature", "value", (lam * dot("_e", "_v")).alias("_x"))
    by = Window.partitionBy("entity", "feature")
    e = F.exp(F.col("_x") - F.max("_x").over(by))
    return rows.withColumn("_y", e).select("entity", "feature", "value", (F.col("_y") / F.sum("_y").over(by)).alias("p"))


def sigmoid_profiles(entities: DataFrame, columns: DataFrame) -> DataFrame:
    """(entity, bin_col, p): the logistic form for binary columns."""
    rows = entities.select("entity", F.col("vec").alias("_e")).crossJoin(columns.select("bin_col", F.col("vec").alias("_v")))
    return rows.select("entity", "bin_col", (1 / (1 + F.exp(-dot("_e", "_v")))).alias("p"))


def conjunction_profile(labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """(label, entity, p) for labels like "a & b": the product of the atoms' profiles (fv, entity, p); entities lacking an atom are out."""
    atoms = labels.select("label", F.explode(F.transform(F.split("label", "&"), lambda x: F.trim(x))).alias("fv"), F.size(F.split("label", "&")).alias("_n"))
    rows = atoms.join(profiles, "fv").groupBy("label", "entity", "_n").agg(F.product("p").alias("p"), F.countDistinct("fv").alias("_k"))
    return rows.filter("_k = _n").select("label", "entity", "p")


def rank_of(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(fv_a, fv_b, rank): 1 + candidates with a higher score, for the wanted pairs."""
    ranked = scores.withColumn("rank", F.rank().over(Window.partitionBy("fv_a").orderBy(F.col("score").desc())))
    return ranked.join(targets.select("fv_a", "fv_b"), ["fv_a", "fv_b"]).select("fv_a", "fv_b", "rank")


def top_k_per_query(scores: DataFrame, k: int = 100) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("fv_a").orderBy(F.col("score").desc(), "fv_b"))
    return scores.withColumn("rank", n).filter(F.col("rank") <= k)


def recall_mrr(ranks: DataFrame, cutoffs: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Per domain and overall (null) from (query, domain, rank): the best rank of each query; an unresolved one (null) counts 0."""
    best = ranks.groupBy("query", "domain").agg(F.min("rank").alias("rank"))
    hits = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in cutoffs]
    mrr = F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr")
    return best.rollup("domain").agg(*hits, mrr, F.median("rank").alias("median"), F.count("*").alias("n"))


def family_prevalence(profiles: DataFrame, families: DataFrame, family: str = "family", least_coded: int = 1, least_size: int = 2) -> DataFrame:
    """(fv, family, share): share of a family's coded entities that have the value; families of ``least_size`` entities or more."""
    sizes = written(families.groupBy(family).agg(F.countDistinct("entity").alias("_n")).filter(F.col("_n") >= least_size).select(family), "family-sizes")
    rows = profiles.join(families.select("entity", family).join(sizes, family).hint("shuffle_hash"), "entity")
    out = rows.groupBy("fv", family).agg(F.avg(F.col("present").cast("double")).alias("share"), F.count("*").alias("_c"))
    return out.filter(F.col("_c") >= least_coded).drop("_c")


def prevalence_of_cells(cells: DataFrame, families: DataFrame, family: str = "family", least_coded: int = 1, least_size: int = 2) -> DataFrame:
    """The same from cells (entity, feature, value), where a feature that is observed observes all its values. Tasks count values by family before anything moves."""
    sizes = written(families.groupBy(family).agg(F.countDistinct("entity").alias("_n")).filter(F.col("_n") >= least_size).select(family), "family-sizes")
    # null for 'any value'
    held = cells.filter("feature IS NOT NULL AND value IS NOT NULL").select("entity", "feature", F.explode(F.array("value", F.lit(None))).alias("value")).distinct()
    counts = held.join(families.select("entity", family), "entity", "left").groupBy("feature", "value", family).agg(F.count("*").alias("_n"))
    counts = written(counts, "family-counts")
    coded = counts.filter(F.col("value").isNull() & (F.col("_n") >= least_coded)).join(sizes, family, "left_semi").select("feature", family, F.col("_n").alias("_c"))
    rows = coded.join(counts.filter("value IS NOT NULL").select("feature", "value").distinct(), "feature").join(counts, ["feature", "value", family], "left")
    return rows.select(value_label("feature", "value").alias("fv"), family, (F.coalesce("_n", F.lit(0)) / F.col("_c")).alias("share"))


def prevalence_cosine(a: DataFrame, b: DataFrame, group: str = "family") -> DataFrame:
    """(fv_a, fv_b, score): cosine of prevalences over all groups, where an uncoded one counts 0: a sparse join and sums."""
    size = lambda df, name: df.groupBy("fv").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("_n")).select(F.col("fv").alias(name), F.col("_n").alias(f"_{name}"))
    x = a.select(F.col("fv").alias("fv_a"), group, F.col("share").alias("_x"))
    y = b.select(F.col("fv").alias("fv_b"), group, F.col("share").alias("_y"))
    dots = x.join(y, group).groupBy("fv_a", "fv_b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_d"))
    return dots.join(size(a, "fv_a"), "fv_a").join(size(b, "fv_b"), "fv_b").select("fv_a", "fv_b", F.coalesce(F.try_divide("_d", F.col("_fv_a") * F.col("_fv_b")), F.lit(0.0)).alias("score"))


def common_cosine(a: DataFrame, b: DataFrame, key: str, x: str, least: int = 5, sentinel: float | None = None) -> DataFrame:
    """(fv_a, fv_b, score): cosine over the keys both sides have; fewer than ``least`` give the sentinel, or no row without one."""
    u = a.select(F.col("fv").alias("fv_a"), key, F.col(x).alias("_x"))
    v = b.select(F.col("fv").alias("fv_b"), key, F.col(x).alias("_y"))
    sums = u.join(v, key).groupBy("fv_a", "fv_b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_d"), F.sqrt(F.sum(F.col("_x") * F.col("_x")) * F.sum(F.col("_y") * F.col("_y"))).alias("_n"), F.count("*").alias("_k"))
    score = F.coalesce(F.try_divide("_d", "_n"), F.lit(0.0))
    if sentinel is None:
        return sums.filter(F.col("_k") >= least).select("fv_a", "fv_b", score.alias("score"))
    return sums.select("fv_a", "fv_b", F.when(F.col("_k") >= least, score).otherwise(sentinel).alias("score"))


def centroid_cosine(a: DataFrame, b: DataFrame, vectors: DataFrame, least: int = 3) -> DataFrame:
    """(fv_a, fv_b, score): cosine of the mean vectors (entity, vec) of the entities that have each value, ``least`` of them or more."""
    from lacuna.operators.vectors import centroid

    def means(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter("present").join(vectors, "entity")
        enough = rows.groupBy("fv").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
        return centroid(rows, "fv").join(enough, "fv").select(F.col("fv").alias(name), F.col("vec").alias(f"_{name}"))

    return means(a, "fv_a").crossJoin(means(b, "fv_b")).select("fv_a", "fv_b", cosine("_fv_a", "_fv_b").alias("score"))


def discover(ab: DataFrame, ba: DataFrame, known: DataFrame, domains: DataFrame, k: int = 5, most: int = 50) -> DataFrame:
    """(fv_a, fv_b, mean_rank, domain): unknown pairs in each other's top ``k``, best mean rank first."""
    x = top_k_per_query(ab, k).select("fv_a", "fv_b", F.col("rank").alias("_x"))
    y = top_k_per_query(ba, k).select(F.col("fv_b").alias("fv_a"), F.col("fv_a").alias("fv_b"), F.col("rank").alias("_y"))
    both = x.join(y, ["fv_a", "fv_b"]).join(known.select("fv_a", "fv_b"), ["fv_a", "fv_b"], "left_anti").withColumn("mean_rank", (F.col("_x") + F.col("_y")) / 2)
    return both.join(domains, "fv_a", "left").select("fv_a", "fv_b", "mean_rank", "domain").orderBy("mean_rank", "fv_a", "fv_b").limit(most)


def multi_seed_rank(ranks: DataFrame, *keys: str) -> DataFrame:
    """Mean rank over seeds, halves to even."""
    return ranks.groupBy(*keys).agg(F.bround(F.avg("rank")).cast("int").alias("rank"))


def evaluable_by_all(pairs: DataFrame, *tables: DataFrame) -> DataFrame:
    """Pairs that every table scores."""
    for table in tables:
        pairs = pairs.join(table.select("fv_a", "fv_b"), ["fv_a", "fv_b"], "left_semi")
    return pairs


def chapter_domain(feature: str, bounds: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds the domain of a feature's leading number by ranges (low, high, domain), a small table."""

    def add(rows: DataFrame) -> DataFrame:
        number = F.try_to_number(F.nullif(F.regexp_extract(feature, r"^\D*(\d+)", 1), F.lit("")), F.lit("999999"))
        numbered = rows.withColumn("_no", number.cast("int"))
        return numbered.join(bounds, F.col("_no").between(F.col("low"), F.col("high")), "left").drop("_no", "low", "high")

    return add
