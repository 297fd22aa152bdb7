"""Filling of blanked cells. Every imputer takes cells and blanks (entity, feature) and returns (entity, feature, value, score).

Ties go to the smaller value, and neighbours with equal scores to the smaller entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import cosine
from lacuna.functions.scratch import written
from lacuna.operators.postings import Index, shared_top_k
from lacuna.operators.search import top_k

CELL = ("entity", "feature")


def best_value(scores: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """The value with the highest score of each key, the smallest one on ties."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "value"))
    return scores.withColumn("_n", n).filter("_n = 1").drop("_n")


def modes(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, n): the commonest value of each key."""
    return best_value(cells.groupBy(*keys, "value").agg(F.count("*").alias("n")), *keys, score="n")


def impute_freq(cells: DataFrame, blanks: DataFrame) -> DataFrame:
    """The commonest value of the feature; its share is the score."""
    best = modes(cells, "feature").join(cells.groupBy("feature").agg(F.count("*").alias("all")), "feature")
    return blanks.select(*CELL).join(best, "feature").select(*CELL, "value", (F.col("n") / F.col("all")).alias("score"))


def or_else(preds: DataFrame, fallback: DataFrame, blanks: DataFrame) -> DataFrame:
    """Predictions for all blanks: the first table's, else the second's."""
    other = fallback.select(*CELL, F.col("value").alias("_v"), F.col("score").alias("_s"))
    joined = blanks.select(*CELL).join(preds.select(*CELL, "value", "score"), list(CELL), "left").join(other, list(CELL), "left")
    score = F.when(F.col("value").isNotNull(), F.col("score")).otherwise(F.col("_s"))
    return joined.select(*CELL, F.coalesce("value", "_v").alias("value"), score.alias("score")).filter("value is not null")


def impute_group_majority(cells: DataFrame, blanks: DataFrame, meta: DataFrame, group: str = "genus") -> DataFrame:
    """The commonest value within the entity's group, else of the feature."""
    of = meta.select("entity", group)
    best = modes(cells.join(of, "entity"), group, "feature").withColumn("score", F.col("n").cast("double"))
    own = blanks.select(*CELL).join(of, "entity").join(best, [group, "feature"])
    return or_else(own, impute_freq(cells, blanks), blanks)


def place_of(feature: str, value: str) -> Column:
    """The number of a cell's inverted list."""
    return F.xxhash64(feature, value)


def neighbours(cells: DataFrame, targets: DataFrame, k: int, weights: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """(entity, other, score): the ``k`` entities that share most observed cells with each target, by number or by weight of the feature.

    Cells are places of inverted lists; see ``postings``. ``index``: that of the cells, if it is there already.
    """
    place = place_of("feature", "value").alias("place")
    weighted = cells.withColumn("idf", F.lit(1.0)) if weights is None else cells.join(weights.select("feature", "idf"), "feature")
    asked = weighted.join(targets.select("entity").distinct(), "entity", "left_semi").select(F.col("entity").alias("id"), place, F.col("idf").alias("weight"))
    found = shared_top_k(asked, index or cells.select(F.col("entity").alias("id"), place), k)
    return found.select(F.col("source").alias("entity"), F.col("target").alias("other"), "score")


def votes(near: DataFrame, cells: DataFrame, blanks: DataFrame) -> DataFrame:
    """(entity, feature, value, n, weight): what neighbours hold at the blanks."""
    held = cells.select(F.col("entity").alias("other"), "feature", "value")
    return blanks.select(*CELL).join(near, "entity").join(held, ["other", "feature"]).groupBy(*CELL, "value").agg(F.count("*").alias("n"), F.sum("score").alias("weight"))


def impute_knn(cells: DataFrame, blanks: DataFrame, k: int = 5, weights: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """The commonest value among the nearest entities; with ``weights`` (feature, idf) rarer features count more."""
    counted = votes(neighbours(cells, blanks, k, weights, index), cells, blanks)
    best = best_value(counted.withColumn("score", F.col("n").cast("double")), *CELL)
    return or_else(best, impute_freq(cells, blanks), blanks)


def idf_knn_distribution(cells: DataFrame, blanks: DataFrame, p: DataFrame, weights: DataFrame, k: int = 5) -> DataFrame:
    """(entity, feature, value, score): neighbours' weighted vote, drawn to the marginal by 1 / (1 + number of votes)."""
    counted = votes(neighbours(cells, blanks, k, weights), cells, blanks)
    rows = blanks.select(*CELL).join(p, "feature").join(counted, [*CELL, "value"], "left")
    by = Window.partitionBy(*CELL)
    support, total = F.coalesce(F.sum("n").over(by), F.lit(0)), F.sum("weight").over(by)
    beta = 1 / (1 + support)
    share = F.coalesce(F.try_divide(F.coalesce("weight", F.lit(0.0)), total), F.lit(0.0))
    return rows.select(*CELL, "value", (beta * F.col("p") + (1 - beta) * share).alias("score"))


def impute_vector_knn(cells: DataFrame, blanks: DataFrame, vectors: DataFrame, meta: DataFrame, k: int = 1, group: str = "genus") -> DataFrame:
    """The value of the ``k`` entities outside the group, observed on the feature, whose vectors are nearest."""
    known = vectors.join(meta.select("entity", group), "entity")
    there = cells.join(known, "entity").select("feature", F.col("entity").alias("id"), "vec", F.col(group).alias("group"))
    here = blanks.select(*CELL).join(known, "entity").select("feature", F.col("entity").alias("id"), "vec", F.col(group).alias("group"))
    near = top_k(here, there, k, "euclidean", keys=["feature"], other_group=True)
    held = near.join(cells.select(F.col("entity").alias("target"), "feature", "value"), ["target", "feature"]).withColumnRenamed("source", "entity")
    best = held.groupBy(*CELL, "value").agg(F.count("*").cast("double").alias("score"))
    return or_else(best_value(best, *CELL), impute_freq(cells, blanks), blanks)


def context_scores(cells: DataFrame, blanks: DataFrame, book: DataFrame, cooc: DataFrame, counts: DataFrame, alpha: float, least: int) -> DataFrame:
    """(entity, feature, value, total, mean): log conditional probabilities of each value given every observed cell of the entity."""
    context = cells.select("entity", F.col("feature").alias("fi"), F.col("value").alias("vi"))
    seen = counts.select(F.col("feature").alias("fi"), F.col("value").alias("vi"), F.col("n").alias("n_i")).filter(F.col("n_i") >= least)
    rows = blanks.select(*CELL).join(context, "entity").filter("feature <> fi").join(seen, ["fi", "vi"]).join(book.select("feature", "value", "k"), "feature")
    joint = cooc.select("fi", "vi", F.col("fj").alias("feature"), F.col("vj").alias("value"), "n")
    rows = rows.join(joint, ["fi", "vi", "feature", "value"], "left")
    term = F.ln((F.coalesce("n", F.lit(0)) + alpha) / (F.col("n_i") + alpha * F.col("k")) + 1e-12)
    return rows.groupBy(*CELL, "value").agg(F.sum(term).alias("total"), F.avg(term).alias("mean"))


def impute_condprob(cells: DataFrame, blanks: DataFrame, book: DataFrame, cooc: DataFrame, counts: DataFrame, alpha: float = 0.5, least: int = 5) -> DataFrame:
    """The value most probable given the other cells of the entity, taken as independent; else the commonest."""
    scores = context_scores(cells, blanks, book, cooc, counts, alpha, least).withColumn("score", F.col("total"))
    return or_else(best_value(scores, *CELL), impute_freq(cells, blanks), blanks)


def rerank_with_prior(scores: DataFrame, prior: DataFrame, lam: float) -> DataFrame:
    """Best value by log score plus ``lam`` times the mean log prior (entity, feature, value, mean); no prior counts 0."""
    both = scores.join(prior.select(*CELL, "value", "mean"), [*CELL, "value"], "left")
    return best_value(both.withColumn("score", F.ln(F.col("score") + 1e-12) + lam * F.coalesce("mean", F.lit(0.0))), *CELL).select(*CELL, "value", "score")


def ppmi_expert(
    cells: DataFrame, blanks: DataFrame, book: DataFrame, cooc: DataFrame, counts: DataFrame, p: DataFrame, nmi: DataFrame, alpha: float = 0.5, least: int = 5, temperature: float = 1.0, top_k: int = 10
) -> DataFrame:
    """(entity, feature, value, score): softmax of the NMI-weighted positive PMI with the best ``top_k`` context features.

    Pairs seen in fewer than two entities are skipped; blanks without any context get the marginal.
    """
    sym = nmi.union(nmi.select(F.col("fj").alias("fi"), F.col("fi").alias("fj"), "nmi")).filter("nmi > 0")
    context = cells.select("entity", F.col("feature").alias("fi"), F.col("value").alias("vi"))
    seen = counts.select(F.col("feature").alias("fi"), F.col("value").alias("vi"), F.col("n").alias("n_i")).filter(F.col("n_i") >= least)
    rows = blanks.select(*CELL).join(context, "entity").join(sym.withColumnRenamed("fj", "feature"), ["fi", "feature"]).join(seen, ["fi", "vi"])
    n = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.col("nmi").desc(), "fi"))
    rows = rows.withColumn("_n", n).filter(F.col("_n") <= top_k).drop("_n").withColumn("w", F.col("nmi") / F.sum("nmi").over(Window.partitionBy(*CELL)))
    joint = cooc.select("fi", "vi", F.col("fj").alias("feature"), F.col("vj").alias("value"), "n").filter("n >= 2")
    terms = rows.join(book.select("feature", "value", "k"), "feature").join(joint, ["fi", "vi", "feature", "value"], "left").join(p, ["feature", "value"])
    cond = (F.col("n") + alpha) / (F.col("n_i") + alpha * F.col("k"))
    gain = F.coalesce(F.col("w") * F.greatest(F.lit(0.0), F.ln(cond / F.col("p"))), F.lit(0.0))
    logits = terms.groupBy(*CELL, "value").agg((F.sum(gain) / temperature).alias("logit"))
    by = Window.partitionBy(*CELL)
    e = F.exp(F.col("logit") - F.max("logit").over(by))
    soft = logits.withColumn("e", e).withColumn("soft", F.col("e") / F.sum("e").over(by)).select(*CELL, "value", "soft")
    return blanks.select(*CELL).join(p, "feature").join(soft, [*CELL, "value"], "left").select(*CELL, "value", F.coalesce("soft", "p").alias("score"))


def add_vectors(scores: DataFrame, cells: DataFrame, vectors: DataFrame, nmi: DataFrame, rho: float) -> DataFrame:
    """Adds ``rho`` times the NMI-weighted cosine between the vectors (feature, value, vec) of a value and of each context value."""
    sym = nmi.union(nmi.select(F.col("fj").alias("fi"), F.col("fi").alias("fj"), "nmi"))
    context = cells.join(vectors, ["feature", "value"]).select("entity", F.col("feature").alias("fi"), F.col("vec").alias("v2"))
    rows = scores.join(vectors, ["feature", "value"]).join(context, "entity").join(sym.withColumnRenamed("fj", "feature"), ["fi", "feature"])
    sums = rows.groupBy(*CELL, "value").agg(F.try_divide(F.sum(F.col("nmi") * cosine("vec", "v2")), F.sum("nmi")).alias("near"))
    return scores.join(sums, [*CELL, "value"], "left").select(*CELL, "value", (F.col("score") + rho * F.coalesce("near", F.lit(0.0))).alias("score"))


def log_linear_mixture(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Best value by the weighted sum of log scores over systems (system, entity, feature, value, score) and (system, weight)."""
    total = scores.join(weights, "system").groupBy(*CELL, "value").agg(F.sum(F.col("weight") * F.ln(F.col("score") + 1e-12)).alias("score"))
    return best_value(total, *CELL)


def impute_log_confidence(sources: DataFrame, blanks: DataFrame, confidence: DataFrame, cells: DataFrame, top_k: int = 5) -> DataFrame:
    """Sums the ``top_k`` sources of the entity with the highest best score; blanks without a positive sum get the commonest value."""
    own = sources.select("entity", F.col("feature").alias("source"), F.col("value").alias("sv"))
    rows = blanks.select("entity", F.col("feature").alias("target")).join(own, "entity").join(confidence, ["source", "sv", "target"])
    by = Window.partitionBy("entity", "target")
    best = rows.withColumn("best", F.max("score").over(by.partitionBy("entity", "target", "source")))
    place = F.dense_rank().over(by.orderBy(F.col("best").desc(), "source"))
    top = best.withColumn("_n", place).filter(F.col("_n") <= top_k)
    # whole numbers add up to the same sum in any order
    whole = F.sum(F.round(F.col("score") * 1e9).cast("long"))
    sums = top.groupBy("entity", F.col("target").alias("feature"), F.col("tv").alias("value")).agg((whole / 1e9).alias("score"))
    return or_else(best_value(sums, *CELL).filter("score <> 0"), impute_freq(cells, blanks).withColumn("score", F.lit(0.0)), blanks)


def impute_best_source(sources: DataFrame, blanks: DataFrame, counts: DataFrame, confidence: DataFrame, cells: DataFrame) -> DataFrame:
    """The value of the single best source; its score is joint over source count. Without one, the commonest value with score 0."""
    own = sources.select("entity", F.col("feature").alias("source"), F.col("value").alias("sv"))
    rows = blanks.select("entity", F.col("feature").alias("target")).join(own, "entity").join(confidence.drop("n_st"), ["source", "sv", "target"])
    n = F.row_number().over(Window.partitionBy("entity", "target").orderBy(F.col("score").desc(), "source", "tv"))
    best = rows.withColumn("_n", n).filter("_n = 1").drop("_n", "score")
    joint = best.join(counts.select("source", "sv", "target", "tv", "n_joint", "n_st"), ["source", "sv", "target", "tv"], "left")
    preds = joint.select("entity", F.col("target").alias("feature"), F.col("tv").alias("value"), F.coalesce(F.col("n_joint") / F.col("n_st"), F.lit(0.0)).alias("score"))
    return or_else(preds, impute_freq(cells, blanks).withColumn("score", F.lit(0.0)), blanks)


def merge_by_threshold(a: DataFrame, b: DataFrame, t1: float, t2: float) -> DataFrame:
    """``a`` where its score is above ``t1`` and that of ``b`` below ``t2``, else ``b``."""
    other = b.select(*CELL, F.col("value").alias("vb"), F.col("score").alias("sb"))
    pick = (F.col("score") > t1) & (F.col("sb") < t2)
    return a.join(other, list(CELL)).select(*CELL, F.when(pick, F.col("value")).otherwise(F.col("vb")).alias("value"), (F.col("value") != F.col("vb")).alias("disagree"), pick.alias("from_a"))


def majority_vote(preds: DataFrame) -> DataFrame:
    """The value that most systems predict."""
    return best_value(preds.groupBy(*CELL, "value").agg(F.count("*").cast("double").alias("score")), *CELL)


def agreement_features(preds: DataFrame) -> DataFrame:
    """Per cell: plurality value, its count and share, numbers of systems and of different values."""
    counted = preds.groupBy(*CELL, "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*CELL)
    wide = counted.withColumn("n_systems", F.sum("n").over(by)).withColumn("n_values", F.count("*").over(by))
    best = best_value(wide, *CELL, score="n")
    return best.select(*CELL, F.col("value").alias("plurality"), F.col("n").alias("n_agree"), (F.col("n") / F.col("n_systems")).alias("share"), "n_systems", "n_values")


def pairwise_agreement(preds: DataFrame) -> DataFrame:
    """(entity, feature, a, b, agree) of each pair of systems."""
    left, right = (preds.select(*CELL, F.col("system").alias(s), F.col("value").alias(v)) for s, v in (("a", "va"), ("b", "vb")))
    return left.join(right, list(CELL)).filter("a < b").select(*CELL, "a", "b", (F.col("va") == F.col("vb")).alias("agree"))


def agreement_heuristic(preds: DataFrame, meta: DataFrame, order: DataFrame, enough: int = 6, group: str = "genus") -> DataFrame:
    """The plurality if ``enough`` systems agree, else the first system in the group's order (group, system, place); null group: default."""
    plural = agreement_features(preds).select(*CELL, "plurality", "n_agree")
    ranked = preds.join(meta.select("entity", group), "entity").join(order.select(F.col("group").alias(group), "system", "place"), [group, "system"])
    first = ranked.groupBy(*CELL).agg(F.min_by("value", "place").alias("preferred"))
    return plural.join(first, list(CELL), "left").select(*CELL, F.when(F.col("n_agree") >= enough, F.col("plurality")).otherwise(F.coalesce("preferred", "plurality")).alias("value"))


def best_system(scored: DataFrame, *keys: str, least: int = 5) -> DataFrame:
    """(keys, system): the most accurate system on simulated rows (system, right); keys with fewer than ``least`` rows are left out."""
    acc = scored.groupBy(*keys, "system").agg(F.avg(F.col("right").cast("double")).alias("acc"), F.count("*").alias("n"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("acc").desc(), "system"))
    return acc.filter(F.col("n") >= least).withColumn("_n", n).filter("_n = 1").select(*keys, "system", "acc")


def apply_best_system(preds: DataFrame, best: DataFrame, blanks: DataFrame, fallback: str, last: DataFrame, *keys: str) -> DataFrame:
    """Each blank from the system that is best for its keys, else from ``fallback``, else from ``last``."""
    own = blanks.join(best.select(*keys, "system"), list(keys), "left").withColumn("system", F.coalesce("system", F.lit(fallback)))
    chosen = own.join(preds, [*CELL, "system"]).select(*CELL, "value", "score")
    second = preds.filter(F.col("system") == fallback).select(*CELL, "value", "score")
    return or_else(chosen, or_else(second, last, blanks), blanks)


def confident_pseudo_labels(scores: DataFrame, cells: DataFrame, tau: float = 0.3, n: int = 5) -> DataFrame:
    """Cells plus, per entity, at most ``n`` predictions whose best two scores are ``tau`` apart; observations are never overwritten."""
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.col("score").desc(), "value"))
    two = scores.withColumn("_n", place).filter("_n <= 2").groupBy(*CELL).agg(
        F.max_by("value", -F.col("_n")).alias("value"), (F.max("score") - F.coalesce(F.min(F.when(F.col("_n") == 2, F.col("score"))), F.lit(0.0))).alias("margin")
    )
    sure = two.filter(F.col("margin") >= tau).join(cells.select(*CELL), list(CELL), "left_anti")
    best = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("margin").desc(), "feature"))
    added = sure.withColumn("_n", best).filter(F.col("_n") <= n).select(*CELL, "value").withColumn("pseudo", F.lit(True))
    return cells.select(*CELL, "value").withColumn("pseudo", F.lit(False)).unionByName(added)


def mean_targets(train: DataFrame, test: DataFrame, group: str = "family") -> DataFrame:
    """(entity, target, overall, by_group, constant): means of a numeric target (entity, target, y); a group without data has the overall mean."""
    overall = train.groupBy("target").agg(F.avg("y").alias("overall"))
    grouped = train.groupBy("target", group).agg(F.avg("y").alias("by_group"))
    joined = test.select("entity", "target", group).join(overall, "target", "left").join(grouped, ["target", group], "left")
    half = F.lit(0.5)
    return joined.select("entity", "target", F.coalesce("overall", half).alias("overall"), F.coalesce("by_group", "overall", half).alias("by_group"), half.alias("constant"))


def warm_start_vector(near: DataFrame, vectors: DataFrame, targets: DataFrame) -> DataFrame:
    """(entity, vec): mean vector of the nearest entities, else of all."""
    from lacuna.operators.vectors import centroid

    own = centroid(near.join(vectors.withColumnRenamed("entity", "other"), "other").select("entity", "vec"), "entity")
    every = centroid(vectors.select(F.lit(0).alias("_all"), "vec"), "_all").select(F.col("vec").alias("_mean"))
    return targets.select("entity").distinct().join(own, "entity", "left").crossJoin(F.broadcast(every)).select("entity", F.coalesce("vec", "_mean").alias("vec"))


def factorise(triples: DataFrame, rank: int = 8, seed: int = 42, steps: int = 5):
    """An implicit-feedback ALS model over (entity, gid)."""
    from pyspark.ml.recommendation import ALS

    return ALS(rank=rank, maxIter=steps, implicitPrefs=True, seed=seed, userCol="entity", itemCol="gid", ratingCol="one", coldStartStrategy="drop").fit(triples.withColumn("one", F.lit(1.0)))


def impute_factorised(cells: DataFrame, blanks: DataFrame, book: DataFrame, rank: int = 8, seed: int = 42) -> DataFrame:
    """The value with the highest low-rank score; else the commonest. Entities are integers."""
    from lacuna.operators.coding import observed_triples

    model = factorise(observed_triples(cells, book).select(F.col("entity").cast("int").alias("entity"), F.col("gid").cast("int").alias("gid")), rank, seed)
    rows = blanks.select(*CELL).join(book.select("feature", "value", F.col("gid").cast("int").alias("gid")), "feature").withColumn("entity", F.col("entity").cast("int"))
    scored = model.transform(rows).select(F.col("entity").cast("long").alias("entity"), "feature", "value", F.col("prediction").cast("double").alias("score"))
    return or_else(best_value(scored, *CELL), impute_freq(cells, blanks), blanks)


def override_on_agreement(base: DataFrame, preds: DataFrame, enough: int) -> DataFrame:
    """The base prediction, replaced where ``enough`` systems agree on a value."""
    plural = agreement_features(preds).select(*CELL, "plurality", "n_agree")
    return base.join(plural, list(CELL), "left").select(*CELL, F.when(F.col("n_agree") >= enough, F.col("plurality")).otherwise(F.col("value")).alias("value"))


def candidate_rows(
    cells: DataFrame, blanks: DataFrame, book: DataFrame, p: DataFrame, entropy: DataFrame, preds: DataFrame, meta: DataFrame, systems: Sequence[str] = (), controlled: Sequence[str] = (),
    left_out: DataFrame | None = None,
) -> DataFrame:
    """One row per (blank, candidate value) with figures for a meta-classifier: those of ``FIGURES``, and by system those of ``system_figures``.

    Of the entity: place, distance to the nearest other entity that has cells, its number of cells, whether its genus and family have any, and whether
    the genus is ``controlled``. Of the feature: number of values and of entities, entropy, number of the commonest value. Of the cell: votes for the
    first and the second value, numbers of systems and values, whether all agree. Of the candidate: number in the code book, marginal, votes and their
    share and mean score, whether it leads, is the feature's commonest, and its share in the genus and the family.

    If the blanks are observed cells that ``preds`` leaves out, ``left_out`` has the figures without each cell (``leave_out.own_counts``); the entropy stays that of all.
    """
    from lacuna.operators.evaluate import min_haversine_km

    # figures of an entity and of a cell come first, so that a row per candidate meets only tables of values, which are written so that plans know how small they are
    by = F.collect_list("system") if systems else F.array()
    voted = preds.groupBy(*CELL, "value").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), by.alias("by"))
    said = voted.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value", "mean_score", "by"))).alias("_said"))
    first, n_systems = F.get("_said", F.lit(0)), F.aggregate("_said", F.lit(0).cast("long"), lambda n, x: n - x["less"])
    by_system = {f"_{s}": F.expr(f"get(filter(_said, x -> array_contains(x.by, '{s}')), 0).value") for s in systems}
    figures = {"plurality": first["value"], "n_agree": -first["less"], "share": -first["less"] / n_systems, "n_systems": n_systems, "n_values": F.size("_said"), "n_second": -F.get("_said", F.lit(1))["less"]}
    said = said.withColumns({**figures, **by_system})
    places = meta.select("entity", "genus", "family", "latitude", "longitude")
    known = cells.groupBy("entity").agg(F.count("*").alias("n_known"))
    km = min_haversine_km(places.join(blanks.select("entity").distinct(), "entity", "left_semi"), places.join(known, "entity", "left_semi"))
    rows = blanks.select(*CELL).join(said, list(CELL), "left").join(places, "entity", "left").join(km, "entity", "left")
    if left_out is None:
        rows = rows.join(known, "entity", "left")
    values = book.select("feature", "value", "k", F.col("vi").alias("value_no")).join(p, ["feature", "value"]).join(entropy, "feature")
    if left_out is None:
        commonest = modes(cells, "feature").join(book.select("feature", "value", F.col("vi").alias("majority_no")), ["feature", "value"]).select("feature", F.col("value").alias("_common"), "majority_no")
        spread = cells.groupBy("feature").agg(F.countDistinct("entity").alias("n_entities"))
        values = values.join(commonest, "feature", "left").join(spread, "feature", "left")
    else:
        values = values.drop("p")
    rows = rows.join(written(values, "candidate-values"), "feature")
    mine = F.get(F.filter("_said", lambda x: x["value"] == F.col("value")), F.lit(0))
    rows = rows.withColumns({"n_votes": -mine["less"], "mean_score": mine["mean_score"]}).drop("_said")
    if left_out is None:
        for group in ("genus", "family"):
            counts = cells.join(meta.select("entity", group), "entity").groupBy(group, "feature", "value").agg(F.count("*").alias("_n"))
            total = Window.partitionBy(group, "feature")
            shares = written(counts.withColumn(f"{group}_share", F.col("_n") / F.sum("_n").over(total)).drop("_n"), f"candidate-{group}")
            known_groups = written(shares.select(group, F.lit(1).alias(f"{group}_known")).distinct(), f"candidate-{group}")
            rows = rows.join(shares, [group, "feature", "value"], "left").join(known_groups, group, "left")
    else:
        own = left_out.join(book.select("feature", F.col("value").alias("majority"), F.col("vi").alias("_no")), ["feature", "majority"], "left")
        names = {"p": "p", "genus_share": "genus_share", "family_share": "family_share", "genus_known": "genus_known", "family_known": "family_known", "n_known": "n_known", "n_entities": "n_entities", "_common": "majority", "majority_no": "_no"}
        rows = rows.join(own.select(*CELL, "value", *(F.col(c).alias(n) for n, c in names.items())), [*CELL, "value"])
    rows = rows.withColumns(
        {
            "is_plurality": (F.col("value") == F.col("plurality")).cast("int"),
            "is_majority": (F.col("value") == F.col("_common")).cast("int"),
            "controlled": F.col("genus").isin(list(controlled)).cast("int") if controlled else F.lit(0),
            "all_agree": (F.col("n_agree") == F.col("n_systems")).cast("int"),
            "vote_share": F.col("n_votes") / F.col("n_systems"),
            **{f"said_{s}": (F.col(f"_{s}") == F.col("value")).cast("int") for s in systems},
            **{f"leads_{s}": (F.col(f"_{s}") == F.col("plurality")).cast("int") for s in systems},
            **{f"agree_{s}_{t}": (F.col(f"_{s}") == F.col(f"_{t}")).cast("int") for i, s in enumerate(systems) for t in systems[i + 1 :]},
        }
    )
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (*FIGURES, *system_figures(systems))}
    return rows.select(*CELL, "value", "genus", *(e.alias(c) for c, e in zero.items()))


#: Columns of ``candidate_rows`` that a meta-classifier may use.
FIGURES = (
    "p", "h", "k", "n_votes", "mean_score", "n_agree", "share", "n_systems", "n_values", "is_plurality", "genus_share", "family_share", "n_known", "latitude", "longitude",
    "km", "genus_known", "family_known", "controlled", "n_entities", "majority_no", "value_no", "is_majority", "all_agree", "n_second", "vote_share",
)


def system_figures(systems: Sequence[str]) -> list[str]:
    """Whether a system says the candidate, whether it says the leading value, and whether two say the same."""
    return [*(f"said_{s}" for s in systems), *(f"leads_{s}" for s in systems), *(f"agree_{s}_{t}" for i, s in enumerate(systems) for t in systems[i + 1 :])]


def stack_systems(train: DataFrame, test: DataFrame, kind: str = "gbt", seed: int = 42) -> DataFrame:
    """Best value of each blank by a meta-classifier over candidate rows; ``train`` has a column ``right`` (0/1).

    ``gbt`` is one boosted classifier of candidates; ``forest`` is one forest for all features, with the feature's number as a column.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    columns = [c for c in train.columns if c in FIGURES or c.startswith(("said_", "leads_", "agree_"))]
    steps = []
    if kind == "forest":
        steps.append(StringIndexer(inputCol="feature", outputCol="feature_no", handleInvalid="keep"))
        columns.append("feature_no")
    steps.append(VectorAssembler(inputCols=columns, outputCol="x"))
    common = {"featuresCol": "x", "labelCol": "right", "seed": seed, "maxDepth": 4}
    steps.append(RandomForestClassifier(numTrees=20, **common) if kind == "forest" else GBTClassifier(maxIter=10, **common))
    scored = Pipeline(stages=steps).fit(train).transform(test)
    rows = scored.select(*CELL, "value", F.round(vector_to_array("probability")[1], 9).alias("score"))
    return best_value(rows, *CELL)


def cross_validate_stack(rows: DataFrame, folds: int = 3, kind: str = "gbt") -> DataFrame:
    """(fold, acc, n): accuracy of the stack when each fold of genera is left out."""
    from lacuna.operators.splits import group_kfold

    dealt = group_kfold(rows, "genus", folds)
    out = None
    for fold in range(folds):
        test = dealt.filter(F.col("fold") == fold)
        best = stack_systems(dealt.filter(F.col("fold") != fold), test, kind)
        right = best.join(test.filter("right = 1").select(*CELL, F.col("value").alias("truth")), list(CELL))
        acc = right.agg(F.lit(fold).alias("fold"), F.avg((F.col("value") == F.col("truth")).cast("double")).alias("acc"), F.count("*").alias("n"))
        out = acc if out is None else out.unionByName(acc)
    return out
