"""Scoring of predictions, rankings and experiment ledgers. Replicates of tests are a column, so each test is one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.columns import average_rank, correlation, draw, haversine_km, numbered, permuted, poisson_counts
from lacuna.functions.ranks import ranked
from lacuna.functions.scratch import written
from lacuna.operators.search import top_k

CELL = ("entity", "feature")


def decode_binary(probs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(entity, feature, value) from (entity, bin_col, p): one column decides at 0.5, several by the highest p, the first on ties."""
    joined = probs.join(catalog, "bin_col")
    n = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.col("p").desc(), "pos"))
    best = joined.withColumn("_n", n).filter("_n = 1")
    single = F.when(F.col("p") > 0.5, F.col("pos_value")).otherwise(F.col("neg_value"))
    return best.select(*CELL, F.when(F.col("n_vals") == 2, single).otherwise(F.col("pos_value")).alias("value"))


def judged(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold cells with ``right``; a cell without a prediction is wrong."""
    pred = preds.select(*CELL, F.col("value").alias("_pred"))
    return gold.join(pred, list(CELL), "left").withColumn("right", F.coalesce(F.col("_pred") == F.col("value"), F.lit(False))).drop("_pred")


def accuracy() -> Column:
    return F.avg(F.col("right").cast("double"))


def micro_f1(rows: DataFrame, *keys: str) -> DataFrame:
    """For single-label cells it is the accuracy."""
    return rows.groupBy(*keys).agg(accuracy().alias("f1"), F.count("*").alias("n"))


def entity_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entity").agg(accuracy().alias("acc"), F.count("*").alias("n"))


def macro_by_group(by_entity: DataFrame, meta: DataFrame, group: str = "genus") -> DataFrame:
    """One row: the mean over groups of the mean over their entities."""
    return by_entity.join(meta.select("entity", group), "entity").groupBy(group).agg(F.avg("acc").alias("acc")).agg(F.avg("acc").alias("macro"), F.count("*").alias("n_groups"))


def macro_by_entity(by_entity: DataFrame) -> DataFrame:
    return by_entity.agg(F.avg("acc").alias("macro"), F.count("*").alias("n_entities"))


def group_breakdown(rows: DataFrame, meta: DataFrame, controlled: Sequence[str], group: str = "genus") -> DataFrame:
    """Accuracy over all blanks per controlled group, the others together, and overall (null group)."""
    named = F.when(F.col(group).isin(list(controlled)), F.col(group)).otherwise("other")
    return rows.join(meta.select("entity", group), "entity").withColumn("part", named).rollup("part").agg(accuracy().alias("acc"), F.count("*").alias("n"))


def oracle_ceiling(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold cells, right if any system is right."""
    hit = preds.join(gold, [*CELL, "value"]).select(*CELL).distinct().withColumn("_hit", F.lit(True))
    return gold.join(hit, list(CELL), "left").withColumn("right", F.coalesce("_hit", F.lit(False))).drop("_hit")


#: Draws of a bootstrap that one task makes.
DRAWS = 1 << 20


def bootstrap_draws(rows: DataFrame, n: int, order: str, seed: int = 42) -> DataFrame:
    """(replicate, row columns): ``n`` resamples with replacement. ``rows`` is a table of groups or entities, one row each."""
    placed = written(numbered(rows, draw(seed, order), order, name="_pos").withColumn("_pos", F.col("_pos") - 1), "bootstrap-rows")
    size = placed.count()
    draws = rows.sparkSession.range(0, size * n, 1, max(1, -(-size * n // DRAWS))).select(F.expr(f"id DIV {max(1, size)}").alias("replicate"), (F.col("id") % max(1, size)).alias("_i"))
    draws = draws.select("replicate", F.pmod(draw(seed + 1, "replicate", "_i"), F.lit(size)).alias("_pos"))
    return draws.join(placed, "_pos").drop("_pos")


def bootstrap_ci(by_entity: DataFrame, n: int = 1000, reference: str = "ref", seed: int = 42) -> DataFrame:
    """One row from (entity, acc, ref): mean, its 95 % interval, and the two-sided p of the difference from the reference.

    A row counts in each replicate as often as a hashed Poisson number says, so no resample is ever a table: tasks add up their rows' contributions to ``n`` replicates, and only these sums
    are shuffled. A replicate's mean is over as many rows as it drew, so its spread is that of a resample of the same size up to terms of one in the number of rows
    (``bootstrap_draws`` makes such resamples). The p value compares resampled differences as they are, not centred under the null.
    """
    keyed = by_entity.select("acc", (F.col("acc") - F.col(reference)).alias("_d"), draw(seed, "entity").alias("_key"))
    drawn = keyed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("replicate", "acc", "_d", poisson_counts("_key", "replicate").alias("_n"))
    sums = drawn.filter("_n > 0").groupBy("replicate").agg((F.sum(F.col("_n") * F.col("acc")) / F.sum("_n")).alias("m"), F.round(F.sum(F.col("_n") * F.col("_d")) / F.sum("_n"), 12).alias("d"))
    return interval_of(sums)


def interval_of(replicates: DataFrame) -> DataFrame:
    """(mean, low, high, p) of replicates (m, d)."""
    below, above = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    interval = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    out = replicates.agg(F.avg("m").alias("mean"), interval.alias("_ci"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))
    return out.select("mean", F.col("_ci")[0].alias("low"), F.col("_ci")[1].alias("high"), "p")


def resampled_ci(by_entity: DataFrame, n: int = 1000, reference: str = "ref", seed: int = 42) -> DataFrame:
    """As ``bootstrap_ci``, from exact resamples: each replicate draws as many rows as there are, with replacement."""
    draws = bootstrap_draws(by_entity, n, "entity", seed)
    return interval_of(draws.groupBy("replicate").agg(F.avg("acc").alias("m"), F.round(F.avg(F.col("acc") - F.col(reference)), 12).alias("d")))


def permutation_test(rows: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """One row from (id, arm 0/1, x): the difference of the arms' means and p = (at least as large + 1) / (n + 1).

    In each replicate the rows that a permutation puts among the first places are the arm, so each row knows its arms by arithmetic and only sums of replicates are shuffled.
    """
    sizes = rows.agg(F.sum("arm").alias("_n1"), F.count("*").alias("_n"), (F.avg(F.when(F.col("arm") == 1, F.col("x"))) - F.avg(F.when(F.col("arm") == 0, F.col("x")))).alias("diff"))
    placed = written(numbered(rows, draw(seed, "id"), "id", name="_p").select("x", (F.col("_p") - 1).alias("_p")), "permutation-rows")
    each = placed.crossJoin(F.broadcast(sizes)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # one row beside each row, and n numbers
    dealt = each.withColumn("_a", permuted("_p", "_n", seed, "replicate") < F.col("_n1"))
    by = dealt.groupBy("replicate").agg((F.avg(F.when(F.col("_a"), F.col("x"))) - F.avg(F.when(~F.col("_a"), F.col("x")))).alias("d"), F.first("diff").alias("diff"))
    return by.agg(F.first("diff").alias("diff"), ((F.count_if(F.abs(F.col("d")) >= F.abs(F.col("diff"))) + 1) / (F.count("*") + 1)).alias("p"))


def summarise_runs(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("std"), F.count("*").alias("n"))


def pivot_models(summary: DataFrame, models: Sequence[str], *keys: str) -> DataFrame:
    """One column per model. The models are given, so no job looks for them."""
    return summary.groupBy(*keys).pivot("model", list(models)).agg(F.first("mean"))


def summarise_weighted(runs: DataFrame, weight: str, *keys: str) -> DataFrame:
    """Weighted mean; the plain mean if the weights sum to 0."""
    return runs.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col(weight) * F.col("f1")), F.sum(weight)), F.avg("f1")).alias("mean"), F.count("*").alias("n"))


def count_eval_items(rows: DataFrame, *keys: str) -> DataFrame:
    """Different (entity, feature) behind binary cells."""
    return rows.groupBy(*keys).agg(F.countDistinct(*CELL).alias("n_items"))


def paired_delta(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference of two ledgers where both have the key."""
    return a.select(*keys, F.col("f1").alias("a")).join(b.select(*keys, F.col("f1").alias("b")), list(keys)).withColumn("delta", F.col("a") - F.col("b"))


def best_of_grid(scores: DataFrame, order: str) -> DataFrame:
    """The row with the highest score, the first in ``order`` on ties."""
    return scores.orderBy(F.col("score").desc(), order).limit(1)


def threshold_sweep(a: DataFrame, b: DataFrame, gold: DataFrame, grid: DataFrame) -> DataFrame:
    """(t1, t2, score): accuracy of merging two systems at each grid point."""
    both = a.select(*CELL, F.col("value").alias("va"), F.col("score").alias("sa")).join(b.select(*CELL, F.col("value").alias("vb"), F.col("score").alias("sb")), list(CELL))
    merged = both.join(gold, list(CELL)).crossJoin(F.broadcast(grid))
    value = F.when((F.col("sa") > F.col("t1")) & (F.col("sb") < F.col("t2")), F.col("va")).otherwise(F.col("vb"))
    return merged.groupBy("t1", "t2").agg(F.avg((value == F.col("value")).cast("double")).alias("score"))


def spearman(rows: DataFrame, x: str, y: str, *keys: str, least: int = 3) -> DataFrame:
    """(keys, rho): correlation of average ranks; null with fewer than ``least`` points or a constant side."""
    if keys:
        both = rows.withColumn("_rx", average_rank(x, *keys)).withColumn("_ry", average_rank(y, *keys))
    else:
        both = ranked(ranked(rows, x, name="_rx"), y, name="_ry")
    return both.groupBy(*keys).agg(F.when(F.count("*") >= least, correlation("_rx", "_ry")).alias("rho"), F.count("*").alias("n"))


def kendall(rows: DataFrame, x: str, y: str, item: str, *keys: str, least: int = 3) -> DataFrame:
    """(keys, tau): tau-b by pairs of items within the key."""
    a = rows.select(*keys, F.col(item).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = a.select(*keys, F.col("_i").alias("_j"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    pairs = a.join(b, list(keys)).filter("_i < _j").withColumn("_sx", F.signum(F.col("_x") - F.col("_x2"))).withColumn("_sy", F.signum(F.col("_y") - F.col("_y2")))
    tau = F.try_divide(F.sum(F.col("_sx") * F.col("_sy")), F.sqrt(F.sum(F.abs("_sx")) * F.sum(F.abs("_sy"))))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.join(pairs.groupBy(*keys).agg(tau.alias("_tau")), list(keys), "left").select(*keys, F.when(F.col("n") >= least, F.col("_tau")).alias("tau"), "n")


def ndcg_at_k(rows: DataFrame, relevance: str, score: str, item: str, k: int, *keys: str) -> DataFrame:
    """(keys, ndcg): gain relevance / log2(rank + 1) over the top ``k`` by score, against the best order of all candidates."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_r", F.row_number().over(by.orderBy(F.col(score).desc(), item))).withColumn("_b", F.row_number().over(by.orderBy(F.col(relevance).desc(), item)))
    gain = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col(relevance) / F.log2(F.col(rank) + 1)).otherwise(0.0))
    return ranked.groupBy(*keys).agg(F.coalesce(F.try_divide(gain("_r"), gain("_b")), F.lit(0.0)).alias("ndcg"))


def regret_topk_pairwise(rows: DataFrame, truth: str, score: str, item: str, *keys: str) -> DataFrame:
    """(keys, regret, top1, top3, pairwise): loss of the chosen item, hits of the best one, share of the best three, pair accuracy."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_p", F.row_number().over(by.orderBy(F.col(score).desc(), item))).withColumn("_t", F.row_number().over(by.orderBy(F.col(truth).desc(), item)))
    heads = ranked.groupBy(*keys).agg(
        (F.max(truth) - F.max(F.when(F.col("_p") == 1, F.col(truth)))).alias("regret"),
        F.max(F.when((F.col("_p") == 1) & (F.col("_t") == 1), 1.0).otherwise(0.0)).alias("top1"),
        (F.count_if((F.col("_p") <= 3) & (F.col("_t") <= 3)) / F.least(F.lit(3), F.count("*"))).alias("top3"),
    )
    a = rows.select(*keys, F.col(item).alias("_i"), F.col(truth).alias("_x"), F.col(score).alias("_y"))
    b = a.select(*keys, F.col("_i").alias("_j"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    pairs = a.join(b, list(keys)).filter((F.col("_i") < F.col("_j")) & (F.abs(F.col("_x") - F.col("_x2")) >= 1e-6))
    right = ((F.col("_x") > F.col("_x2")) == (F.col("_y") > F.col("_y2"))).cast("double")
    return heads.join(pairs.groupBy(*keys).agg(F.avg(right).alias("pairwise")), list(keys), "left")


def same_stratum_spearman(rows: DataFrame, x: str, y: str, stratum: str, target_stratum: str, *keys: str) -> DataFrame:
    """Spearman over rows whose stratum is the target's."""
    return spearman(rows.filter(F.col(stratum) == F.col(target_stratum)), x, y, *keys)


def partial_spearman(rows: DataFrame, x: str, y: str, z: str, *keys: str) -> DataFrame:
    """Spearman of the residuals of x and y after a linear fit on z."""
    by = Window.partitionBy(*keys)
    fit = lambda v: F.col(v) - F.coalesce(F.regr_slope(v, z).over(by) * F.col(z) + F.regr_intercept(v, z).over(by), F.avg(v).over(by))
    residual = rows.withColumn("_ex", F.round(fit(x), 6)).withColumn("_ey", F.round(fit(y), 6))
    return spearman(residual, "_ex", "_ey", *keys)


def evaluate_rankings(rows: DataFrame, truth: str, score: str, item: str, k: int = 3) -> DataFrame:
    """(representation, metric means and spreads over targets), best correlation first; one plan for all targets."""
    keys = ["representation", "target"]
    parts = spearman(rows, truth, score, *keys).drop("n").join(kendall(rows, truth, score, item, *keys).drop("n"), keys)
    parts = parts.join(ndcg_at_k(rows, truth, score, item, k, *keys), keys).join(regret_topk_pairwise(rows, truth, score, item, *keys), keys)
    metrics = ["rho", "tau", "ndcg", "regret", "top1", "top3", "pairwise"]
    sums = [f(m).alias(f"{m}{s}") for m in metrics for f, s in ((F.avg, "_mean"), (F.stddev_pop, "_std"))]
    return parts.groupBy("representation").agg(*sums, F.count("*").alias("n_targets")).orderBy(F.col("rho_mean").desc())


def pair_matrix_diagnostics(pairs: DataFrame, strata: DataFrame) -> DataFrame:
    """One row from (source, target, d): spread off the diagonal, mean on it, and means within and across strata (id, stratum)."""
    of = lambda c, to: strata.select(F.col("id").alias(c), F.col("stratum").alias(to))
    rows = pairs.join(of("source", "_s"), "source").join(of("target", "_t"), "target")
    off = F.col("source") != F.col("target")
    only = lambda c: F.when(c, F.col("d"))
    same = F.col("_s") == F.col("_t")
    return rows.agg(
        F.avg(only(off)).alias("mean"), F.stddev_pop(only(off)).alias("std"), F.min(only(off)).alias("min"), F.max(only(off)).alias("max"),
        F.avg(only(~off)).alias("diagonal"), F.avg(only(off & same)).alias("within"), F.avg(only(off & ~same)).alias("across"),
    )


def pair_spread(pairs: DataFrame) -> DataFrame:
    """(target, mean, std, best, worst, spread) over the other sources."""
    off = pairs.filter("source <> target").groupBy("target")
    return off.agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.max("d").alias("best"), F.min("d").alias("worst"), (F.max("d") - F.min("d")).alias("spread"))


def probability_metrics(rows: DataFrame, key: str = "config") -> DataFrame:
    """MAE, RMSE, Brier, KL and count-weighted MAE from (key, truth, pred, n), per key and overall (null key)."""
    clip = lambda c: F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col(c)))
    t, q, gap = clip("truth"), clip("pred"), F.abs(F.col("truth") - F.col("pred"))
    kl = t * F.ln(t / q) + (1 - t) * F.ln((1 - t) / (1 - q))
    brier = F.col("truth") * F.pow(1 - F.col("pred"), 2) + (1 - F.col("truth")) * F.pow("pred", 2)
    return rows.rollup(key).agg(
        F.avg(gap).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(brier).alias("brier"), F.avg(kl).alias("kl"),
        F.try_divide(F.sum(gap * F.col("n")), F.sum("n")).alias("weighted_mae"), F.count("*").alias("rows"),
    )


def calibrate_temperature(scores: DataFrame, gold: DataFrame, grid: DataFrame) -> DataFrame:
    """(t, nll): mean negative log-softmax of the gold value at each temperature, best first."""
    rows = scores.crossJoin(F.broadcast(grid))
    by = Window.partitionBy(*CELL, "t")
    x = F.col("score") / F.col("t")
    top = F.max(x).over(by)
    log_p = x - top - F.ln(F.sum(F.exp(x - top)).over(by))
    return rows.withColumn("_lp", log_p).join(gold, [*CELL, "value"]).groupBy("t").agg((-F.avg("_lp")).alias("nll")).orderBy("nll", "t")


def leave_one_out_sums(parts: DataFrame, part: str, *keys: str) -> DataFrame:
    """(keys, part, mean): the mean over the other parts of each key, by subtraction from the whole: one pass, no refit."""
    by = Window.partitionBy(*keys)
    return parts.select(*keys, part, F.try_divide(F.sum("x").over(by) - F.col("x"), F.count("*").over(by) - 1).alias("mean"))


def feature_importance(parts: DataFrame, gold: DataFrame) -> DataFrame:
    """(feature, rho, drop): correlation with gold (id, y) when a feature is left out of the mean, and what that loses.

    ``parts`` is (id, feature, x); all ids have all features.
    """
    left = leave_one_out_sums(parts, "feature", "id").join(gold, "id")
    full = spearman(parts.groupBy("id").agg(F.avg("x").alias("mean")).join(gold, "id").withColumn("_all", F.lit(0)), "mean", "y", "_all").select(F.col("rho").alias("_full"))
    return spearman(left, "mean", "y", "feature").crossJoin(F.broadcast(full)).select("feature", "rho", (F.col("_full") - F.col("rho")).alias("drop"))


def domain_subset_score(parts: DataFrame, domains: DataFrame, gold: DataFrame, least: int = 2) -> DataFrame:
    """(domain, n_features, rho): the same using only the features of one domain, of at least ``least``."""
    rows = parts.join(domains, "feature")
    sizes = rows.groupBy("domain").agg(F.countDistinct("feature").alias("n_features")).filter(F.col("n_features") >= least)
    means = rows.groupBy("domain", "id").agg(F.avg("x").alias("mean")).join(gold, "id")
    return spearman(means, "mean", "y", "domain").drop("n").join(sizes, "domain")


def aggregate_over_seeds(rows: DataFrame, *keys: str, sample: bool = False) -> DataFrame:
    """Mean and spread of ``x`` over seeds, nulls ignored."""
    spread = F.stddev_samp if sample else F.stddev_pop
    return rows.groupBy(*keys).agg(F.avg("x").alias("mean"), spread("x").alias("std"), F.count("x").alias("n"))


def min_haversine_km(entities: DataFrame, training: DataFrame) -> DataFrame:
    """(entity, km): distance to the nearest other training entity (entity, latitude, longitude). The nearest on the sphere is the nearest
    in space, so it is found by a search among points of the unit sphere.

    Places are searched, each by the smallest of its training entities: whoever shares a place with another one has no way to go."""
    at = ["latitude", "longitude"]
    lat, lon = F.radians("latitude"), F.radians("longitude")
    point = F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    located = lambda df: df.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("entity", *at)
    there = written(located(training).groupBy(*at).agg(F.min("entity").alias("first"), F.count("*").alias("n")), "km-places")
    asked = located(entities).join(located(training).withColumn("_own", F.lit(1)), ["entity", *at], "left").join(there, at, "left")
    asked = written(asked.withColumn("alone", F.coalesce(F.col("n") - F.coalesce("_own", F.lit(0)), F.lit(0)) == 0), "km-asked")
    # who is alone at its place asks for it; a place without training entities goes by the smallest of those who ask
    alone = asked.filter("alone").groupBy(*at).agg(F.min("entity").alias("id"))
    points = lambda df, name: df.select(F.col(name).alias("id"), point.alias("vec"))
    near = top_k(points(alone, "id"), points(there, "first"), 1, "euclidean").select(F.col("source").alias("id"), F.col("target").alias("first"))
    target = there.select("first", F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_la"), F.col("_lo"))
    found = alone.join(near, "id").join(target, "first").select(*at, km.alias("km"))
    return asked.filter("alone").join(found, at).select("entity", "km").unionByName(asked.filter("NOT alone").select("entity", F.lit(0.0).alias("km")))


def grid_search(cells: DataFrame, halves: DataFrame, book: DataFrame, cooc: DataFrame, counts: DataFrame, alphas: Sequence[float], leasts: Sequence[int]) -> DataFrame:
    """(alpha, least, score): accuracy of conditional-probability filling of target halves from context halves, for every grid point.

    All points are one plan: the grid is joined to the rows. Statistics come from ``cells`` only.
    """
    grid = cells.sparkSession.createDataFrame([(float(a), int(n)) for a in alphas for n in leasts], "alpha double, least int")
    context = halves.filter("half = 'context'").select("entity", F.col("feature").alias("fi"), F.col("value").alias("vi"))
    target = halves.filter("half = 'target'").select("entity", "feature", F.col("value").alias("truth"))
    seen = counts.select(F.col("feature").alias("fi"), F.col("value").alias("vi"), F.col("n").alias("n_i"))
    rows = target.join(context, "entity").filter("feature <> fi").join(seen, ["fi", "vi"]).join(book.select("feature", "value", "k"), "feature")
    joint = cooc.select("fi", "vi", F.col("fj").alias("feature"), F.col("vj").alias("value"), "n")
    rows = rows.join(joint, ["fi", "vi", "feature", "value"], "left").crossJoin(F.broadcast(grid)).filter("n_i >= least")
    term = F.ln((F.coalesce("n", F.lit(0)) + F.col("alpha")) / (F.col("n_i") + F.col("alpha") * F.col("k")) + 1e-12)
    totals = rows.groupBy("alpha", "least", *CELL, "value", "truth").agg(F.round(F.sum(term), 9).alias("score"))
    n = F.row_number().over(Window.partitionBy("alpha", "least", *CELL).orderBy(F.col("score").desc(), "value"))
    best = totals.withColumn("_n", n).filter("_n = 1")
    return best.groupBy("alpha", "least").agg(F.avg((F.col("value") == F.col("truth")).cast("double")).alias("score"))
