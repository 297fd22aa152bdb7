"""Queries of evaluation."""

from pyspark.sql import functions as F

from lacuna.operators import coding, evaluate, impute
from lacuna.plans.inputs import LINE_ROWS, draw_sql, permuted_sql
from lacuna.plans.q_coding import CATALOG
from lacuna.plans.registry import query

RIGHT = ", jd AS (SELECT g.entity, g.feature, g.value, coalesce(p.value = g.value, false) AS ok, m.genus, m.family FROM gold g LEFT JOIN (SELECT * FROM preds WHERE system = 'genus') p USING (entity, feature) JOIN meta m USING (entity))"
EA = RIGHT + ", ea AS (SELECT entity, genus, avg(ok::INT) AS acc, count(*) AS n FROM jd GROUP BY entity, genus)"
RUNS = """, runs AS (SELECT l_returnflag AS branch, l_linenumber % 3 AS frac, l_suppkey % 4 AS repeat, CASE l_linestatus WHEN 'O' THEN 'full' ELSE 'base' END AS model, l_discount AS f1, l_quantity AS w FROM lineitem)"""
#: Each order ranks its lines.
RANKS = """, rk AS (SELECT l_orderkey % 3 AS representation, l_orderkey AS target, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS item, l_quantity AS truth, l_extendedprice AS score, l_tax AS z, l_returnflag AS stratum, 'A' AS own FROM lineitem)"""
AVGRANK = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"
RHO = "round(CASE WHEN count(*) >= 3 THEN covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) END, 8)"


def rounded(df, *columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rows_of(i):
    return evaluate.judged(i.preds.filter("system = 'genus'"), i.gold)


def by_entity(i):
    return evaluate.entity_accuracy(rows_of(i))


def runs_of(i):
    return i.table("lineitem").selectExpr("l_returnflag AS branch", "l_linenumber % 3 AS frac", "l_suppkey % 4 AS repeat", "CASE l_linestatus WHEN 'O' THEN 'full' ELSE 'base' END AS model", "l_discount AS f1", "l_quantity AS w")


def rankings_of(i):
    return i.dealt("lineitem", "l_orderkey", LINE_ROWS).selectExpr("l_orderkey % 3 AS representation", "l_orderkey AS target", "(l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS item", "l_quantity AS truth", "l_extendedprice AS score", "l_tax AS z", "l_returnflag AS stratum", "'A' AS own")


@query(CATALOG + """, pr AS (SELECT entity, feature, bin_col, pos, pos_value, neg_value, n_vals, ((entity * 7 + bin_col * 13) % 100) / 100.0 AS pp FROM blanks JOIN cat USING (feature))
SELECT entity, feature, CASE WHEN n_vals = 2 THEN CASE WHEN pp > 0.5 THEN pos_value ELSE neg_value END ELSE pos_value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY pp DESC, pos) AS r FROM pr) WHERE r = 1""")
def e1_decode_binary(i):
    catalog = coding.bin_catalog(i.book)
    probs = i.blanks.join(catalog.select("feature", "bin_col"), "feature").select("entity", "bin_col", F.expr("((entity * 7 + bin_col * 13) % 100) / 100.0D").alias("p"))
    return evaluate.decode_binary(probs, catalog)


@query(RIGHT + "SELECT feature, round(avg(ok::INT), 8) AS f1, count(*) AS n FROM jd GROUP BY feature")
def e2_micro_f1(i):
    return rounded(evaluate.micro_f1(rows_of(i), "feature"), "f1")


@query(EA + "SELECT entity, round(acc, 8) AS acc, n FROM ea")
def e3_entity_accuracy(i):
    return rounded(by_entity(i), "acc")


@query(EA + "SELECT round(avg(acc), 8) AS macro, count(*) AS n_groups FROM (SELECT genus, avg(acc) AS acc FROM ea GROUP BY genus)")
def e4_macro_by_group(i):
    return rounded(evaluate.macro_by_group(by_entity(i), i.meta), "macro")


@query(EA + "SELECT round(avg(acc), 8) AS macro, count(*) AS n_entities FROM ea")
def e5_macro_by_entity(i):
    return rounded(evaluate.macro_by_entity(by_entity(i)), "macro")


@query(RIGHT + "SELECT CASE WHEN genus IN ('Brand#1', 'Brand#2') THEN genus ELSE 'other' END AS part, round(avg(ok::INT), 8) AS acc, count(*) AS n FROM jd GROUP BY ROLLUP (part)")
def e6_group_breakdown(i):
    return rounded(evaluate.group_breakdown(rows_of(i), i.meta, ["Brand#1", "Brand#2"]), "acc")


@query("SELECT g.entity, g.feature, g.value, bool_or(p.value = g.value) AS \"right\" FROM gold g JOIN preds p USING (entity, feature) GROUP BY ALL")
def e7_oracle_ceiling(i):
    return evaluate.oracle_ceiling(i.preds, i.gold)


@query(EA + f""", fr AS (SELECT g.entity, avg(coalesce(p.value = g.value, false)::INT) AS ref FROM gold g LEFT JOIN (SELECT * FROM preds WHERE system = 'freq') p USING (entity, feature) GROUP BY g.entity), pl AS (SELECT acc, ref, row_number() OVER (ORDER BY {draw_sql(42, "entity")}, entity) - 1 AS p FROM ea JOIN fr USING (entity)),
dr AS (SELECT rep, {draw_sql(43, "rep", "i.p")} % (SELECT count(*) FROM pl) AS p FROM pl i CROSS JOIN (SELECT unnest(range(0, 200)) AS rep)), mm AS (SELECT rep, avg(acc) AS m, round(avg(acc - ref), 12) AS d FROM dr JOIN pl USING (p) GROUP BY rep)
SELECT round(avg(m), 8) AS mean, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high, round(least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 8) AS p FROM mm""")
def e8_bootstrap_ci(i):
    base = evaluate.entity_accuracy(evaluate.judged(i.preds.filter("system = 'freq'"), i.gold)).select("entity", F.col("acc").alias("ref"))
    return rounded(evaluate.resampled_ci(by_entity(i).join(base, "entity"), 200), "mean", "low", "high", "p")


@query(f""", t AS (SELECT vec_id AS id, label < 5 AS arm, embedding[1]::DOUBLE AS x FROM embeddings), df AS (SELECT avg(x) FILTER (arm) - avg(x) FILTER (NOT arm) AS diff, count(*) FILTER (arm) AS n1 FROM t),
pl AS (SELECT x, row_number() OVER (ORDER BY {draw_sql(42, "id")}, id) - 1 AS p, count(*) OVER () AS n FROM t), pm AS (SELECT rep, x, {permuted_sql("p", "n", 42, "rep")} < (SELECT n1 FROM df) AS a FROM pl CROSS JOIN (SELECT unnest(range(0, 200)) AS rep)), dd AS (SELECT rep, avg(x) FILTER (a) - avg(x) FILTER (NOT a) AS d FROM pm GROUP BY rep)
SELECT round((SELECT diff FROM df), 8) AS diff, round((count(*) FILTER (abs(d) >= abs((SELECT diff FROM df))) + 1) / (count(*) + 1), 8) AS p FROM dd""")
def e9_permutation_test(i):
    rows = i.table("embeddings").selectExpr("vec_id AS id", "CAST(label < 5 AS INT) AS arm", "CAST(embedding[0] AS DOUBLE) AS x")
    return rounded(evaluate.permutation_test(rows, 200), "diff", "p")


@query(RUNS + "SELECT frac, model, round(avg(f1), 8) AS mean, round(stddev_samp(f1), 8) AS std, count(*) AS n FROM runs GROUP BY frac, model")
def e10_summarise_runs(i):
    return rounded(evaluate.summarise_runs(runs_of(i), "frac", "model"), "mean", "std")


@query(RUNS + "SELECT frac, round(avg(f1) FILTER (model = 'base'), 8) AS base, round(avg(f1) FILTER (model = 'full'), 8) AS full FROM runs GROUP BY frac")
def e10b_pivot_models(i):
    return rounded(evaluate.pivot_models(evaluate.summarise_runs(runs_of(i), "frac", "model"), ["base", "full"], "frac"), "base", "full")


@query(RUNS + "SELECT frac, model, round(sum(w * f1) / sum(w), 8) AS mean, count(*) AS n FROM runs GROUP BY frac, model")
def e11_summarise_weighted(i):
    return rounded(evaluate.summarise_weighted(runs_of(i), "w", "frac", "model"), "mean")


@query(CATALOG + "SELECT feature, count(DISTINCT entity) AS n_items FROM cells JOIN cat USING (feature) GROUP BY feature")
def e12_count_eval_items(i):
    return evaluate.count_eval_items(coding.binarise(i.cells, coding.bin_catalog(i.book)), "feature")


@query(RUNS + ", s AS (SELECT branch, frac, repeat, model, round(avg(f1), 8) AS f1 FROM runs GROUP BY ALL) SELECT branch, frac, repeat, x.f1 AS a, y.f1 AS b, round(x.f1 - y.f1, 8) AS delta FROM s x JOIN s y USING (branch, frac, repeat) WHERE x.model = 'full' AND y.model = 'base'")
def e13_paired_delta(i):
    s = rounded(runs_of(i).groupBy("branch", "frac", "repeat", "model").agg(F.avg("f1").alias("f1")), "f1")
    return rounded(evaluate.paired_delta(s.filter("model = 'full'"), s.filter("model = 'base'"), ["branch", "frac", "repeat"]), "delta")


@query(RUNS + "SELECT frac, repeat, round(avg(f1), 8) AS score FROM runs GROUP BY frac, repeat ORDER BY score DESC, frac * 10 + repeat LIMIT 1")
def e14_best_of_grid(i):
    grid = rounded(runs_of(i).groupBy("frac", "repeat").agg(F.avg("f1").alias("score")), "score").withColumn("no", F.col("frac") * 10 + F.col("repeat"))
    return evaluate.best_of_grid(grid, "no").drop("no")


GRID = ", grid AS (SELECT a.t / 10.0::DOUBLE AS t1, b.t / 10.0::DOUBLE AS t2 FROM range(1, 9) a(t) CROSS JOIN range(1, 9) b(t)), ab AS (SELECT a.entity, a.feature, a.value AS va, (a.entity % 10) / 10.0::DOUBLE AS sa, b.value AS vb, (a.entity % 7) / 7.0::DOUBLE AS sb FROM preds a JOIN preds b USING (entity, feature) WHERE a.system = 'genus' AND b.system = 'family')"


@query(GRID + "SELECT t1, t2, round(avg((CASE WHEN sa > t1 AND sb < t2 THEN va ELSE vb END = g.value)::INT), 8) AS score FROM ab JOIN gold g USING (entity, feature) CROSS JOIN grid GROUP BY t1, t2")
def e15_threshold_sweep(i):
    steps = i.spark.range(1, 9)
    grid = steps.select((F.col("id") / 10).alias("t1")).crossJoin(steps.select((F.col("id") / 10).alias("t2")))
    a = i.preds.filter("system = 'genus'").withColumn("score", (F.col("entity") % 10) / 10)
    b = i.preds.filter("system = 'family'").withColumn("score", (F.col("entity") % 7) / 7)
    return rounded(evaluate.threshold_sweep(a, b, i.gold, grid), "score")


@query(RANKS + f", r AS (SELECT target, {AVGRANK.format(k='target', x='truth')} AS rx, {AVGRANK.format(k='target', x='score')} AS ry FROM rk) SELECT target, {RHO} AS rho, count(*) AS n FROM r GROUP BY target")
def e16_spearman(i):
    return rounded(evaluate.spearman(rankings_of(i), "truth", "score", "target"), "rho")


KENDALL = """SELECT a.target, sum(sign(a.truth - b.truth) * sign(a.score - b.score)) / nullif(sqrt(sum(abs(sign(a.truth - b.truth))) * sum(abs(sign(a.score - b.score)))), 0) AS tau FROM rk a JOIN rk b ON a.target = b.target AND a.item < b.item GROUP BY a.target"""


@query(RANKS + f"SELECT target, round(CASE WHEN n >= 3 THEN tau END, 8) AS tau, n FROM (SELECT target, count(*) AS n FROM rk GROUP BY target) LEFT JOIN ({KENDALL}) USING (target)")
def e16b_kendall(i):
    return rounded(evaluate.kendall(rankings_of(i), "truth", "score", "item", "target"), "tau")


NDCG = """SELECT target, sum(CASE WHEN r <= 3 THEN truth / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN b <= 3 THEN truth / log2(b + 1) ELSE 0 END), 0) AS ndcg FROM
    (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, item) AS r, row_number() OVER (PARTITION BY target ORDER BY truth DESC, item) AS b FROM rk) GROUP BY target"""


@query(RANKS + f"SELECT target, round(coalesce(ndcg, 0), 8) AS ndcg FROM ({NDCG})")
def e17_ndcg_at_k(i):
    return rounded(evaluate.ndcg_at_k(rankings_of(i), "truth", "score", "item", 3, "target"), "ndcg")


REGRET = """SELECT h.*, pairwise FROM (SELECT target, max(truth) - max(CASE WHEN p = 1 THEN truth END) AS regret, max(CASE WHEN p = 1 AND t = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS top1, sum(CASE WHEN p <= 3 AND t <= 3 THEN 1 ELSE 0 END) / least(3, count(*)) AS top3 FROM
    (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, item) AS p, row_number() OVER (PARTITION BY target ORDER BY truth DESC, item) AS t FROM rk) GROUP BY target) h
    LEFT JOIN (SELECT a.target, avg(((a.truth > b.truth) = (a.score > b.score))::INT) AS pairwise FROM rk a JOIN rk b ON a.target = b.target AND a.item < b.item AND abs(a.truth - b.truth) >= 1e-6 GROUP BY a.target) USING (target)"""


@query(RANKS + f"SELECT target, regret, top1, round(top3, 8) AS top3, round(pairwise, 8) AS pairwise FROM ({REGRET})")
def e18_regret_topk_pairwise(i):
    return rounded(evaluate.regret_topk_pairwise(rankings_of(i), "truth", "score", "item", "target"), "top3", "pairwise")


@query(RANKS + f", rs AS (SELECT * FROM rk WHERE stratum = own), r AS (SELECT target, {AVGRANK.format(k='target', x='truth')} AS rx, {AVGRANK.format(k='target', x='score')} AS ry FROM rs) SELECT target, {RHO} AS rho, count(*) AS n FROM r GROUP BY target")
def e19_same_stratum_spearman(i):
    return rounded(evaluate.same_stratum_spearman(rankings_of(i), "truth", "score", "stratum", "own", "target"), "rho")


@query(RANKS + f""", f AS (SELECT target, regr_slope(truth, z) AS b1, regr_intercept(truth, z) AS a1, regr_slope(score, z) AS b2, regr_intercept(score, z) AS a2, avg(truth) AS mt, avg(score) AS ms FROM rk GROUP BY target),
e AS (SELECT target, round(truth - coalesce(b1 * z + a1, mt), 6) AS x, round(score - coalesce(b2 * z + a2, ms), 6) AS y FROM rk JOIN f USING (target)), r AS (SELECT target, {AVGRANK.format(k='target', x='x')} AS rx, {AVGRANK.format(k='target', x='y')} AS ry FROM e) SELECT target, {RHO} AS rho, count(*) AS n FROM r GROUP BY target""")
def e20_partial_spearman(i):
    return rounded(evaluate.partial_spearman(rankings_of(i), "truth", "score", "z", "target"), "rho")


@query(RANKS + f""", r AS (SELECT target, {AVGRANK.format(k='target', x='truth')} AS rx, {AVGRANK.format(k='target', x='score')} AS ry FROM rk), m AS (SELECT * REPLACE (CASE WHEN n >= 3 THEN rho END AS rho, CASE WHEN n >= 3 THEN tau END AS tau) FROM (SELECT representation, target, count(*) AS n FROM rk GROUP BY ALL) JOIN (SELECT target, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) AS rho FROM r GROUP BY target) USING (target)
    LEFT JOIN ({KENDALL}) USING (target) JOIN ({NDCG}) USING (target) JOIN ({REGRET}) USING (target))
SELECT representation, {", ".join(f"round(avg({m}), 7) AS {m}_mean, round(stddev_pop({m}), 7) AS {m}_std" for m in ("rho", "tau", "ndcg", "regret", "top1", "top3", "pairwise"))}, count(*) AS n_targets FROM m GROUP BY representation""")
def e21_evaluate_rankings(i):
    out = evaluate.evaluate_rankings(rankings_of(i), "truth", "score", "item")
    return rounded(out, *(c for c in out.columns if c.endswith(("_mean", "_std"))), digits=7)


MATRIX = ", mx AS (SELECT s.n_nationkey AS source, t.n_nationkey AS target, ((s.n_nationkey * 7 + t.n_nationkey * 11) % 17) / 17.0::DOUBLE AS d FROM nation s CROSS JOIN nation t), st AS (SELECT n_nationkey AS id, n_regionkey AS stratum FROM nation)"


def matrix_of(i):
    n = i.table("nation")
    pairs = n.select(F.col("n_nationkey").alias("source")).crossJoin(n.select(F.col("n_nationkey").alias("target")))
    return pairs.withColumn("d", F.expr("((source * 7 + target * 11) % 17) / 17.0D")), n.selectExpr("n_nationkey AS id", "n_regionkey AS stratum")


@query(MATRIX + """SELECT round(avg(d) FILTER (source <> target), 8) AS mean, round(stddev_pop(d) FILTER (source <> target), 8) AS std, min(d) FILTER (source <> target) AS min, max(d) FILTER (source <> target) AS max, round(avg(d) FILTER (source = target), 8) AS diagonal,
    round(avg(d) FILTER (source <> target AND a.stratum = b.stratum), 8) AS within, round(avg(d) FILTER (source <> target AND a.stratum <> b.stratum), 8) AS across FROM mx JOIN st a ON a.id = source JOIN st b ON b.id = target""")
def e22_pair_matrix_diagnostics(i):
    return rounded(evaluate.pair_matrix_diagnostics(*matrix_of(i)), "mean", "std", "diagonal", "within", "across")


@query(MATRIX + "SELECT target, round(avg(d), 8) AS mean, round(stddev_pop(d), 8) AS std, max(d) AS best, min(d) AS worst, round(max(d) - min(d), 8) AS spread FROM mx WHERE source <> target GROUP BY target")
def e22b_pair_spread(i):
    return rounded(evaluate.pair_spread(matrix_of(i)[0]), "mean", "std", "spread")


@query(""", pm AS (SELECT l_returnflag AS config, l_discount * 8 AS truth, l_tax * 10 AS pred, l_quantity AS n FROM lineitem), c AS (SELECT *, least(1 - 1e-7, greatest(1e-7, truth)) AS t, least(1 - 1e-7, greatest(1e-7, pred)) AS q FROM pm)
SELECT config, round(avg(abs(truth - pred)), 8) AS mae, round(sqrt(avg((truth - pred) ** 2)), 8) AS rmse, round(avg(truth * (1 - pred) ** 2 + (1 - truth) * pred ** 2), 8) AS brier, round(avg(t * ln(t / q) + (1 - t) * ln((1 - t) / (1 - q))), 7) AS kl, round(sum(abs(truth - pred) * n) / sum(n), 8) AS weighted_mae, count(*) AS rows FROM c GROUP BY ROLLUP (config)""")
def e23_probability_metrics(i):
    rows = i.table("lineitem").selectExpr("l_returnflag AS config", "l_discount * 8 AS truth", "l_tax * 10 AS pred", "l_quantity AS n")
    return rounded(rounded(evaluate.probability_metrics(rows), "mae", "rmse", "brier", "weighted_mae"), "kl", digits=7)


@query(""", g AS (SELECT t / 4.0::DOUBLE AS t FROM range(1, 13) r(t)), s AS (SELECT b.entity, b.feature, p.value, t, p.p * 5 / t AS x FROM blanks b JOIN p USING (feature) CROSS JOIN g), l AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY entity, feature, t)) AS lp FROM s)
SELECT t, round(-avg(lp), 7) AS nll FROM l JOIN gold USING (entity, feature, value) GROUP BY t""")
def e24_calibrate_temperature(i):
    scores = i.blanks.join(i.p, "feature").select("entity", "feature", "value", (F.col("p") * 5).alias("score"))
    grid = i.spark.range(1, 13).select((F.col("id") / 4).alias("t"))
    return rounded(evaluate.calibrate_temperature(scores, i.gold, grid), "nll", digits=7)


PARTS = ", parts AS (SELECT vec_id AS id, 'f' || k AS feature, embedding[k + 1]::DOUBLE AS x FROM embeddings CROSS JOIN range(0, 64) r(k)), gy AS (SELECT vec_id AS id, label::DOUBLE AS y FROM embeddings)"


def parts_of(i):
    parts = i.table("embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "x"))
    gold = i.table("embeddings").selectExpr("vec_id AS id", "CAST(label AS DOUBLE) AS y")
    return parts.select("id", F.concat(F.lit("f"), "k").alias("feature"), F.col("x").cast("double").alias("x")), gold


@query(PARTS + f""", lo AS (SELECT p.feature, p.id, (sum(p.x) OVER (PARTITION BY p.id) - p.x) / 63 AS m, y FROM parts p JOIN gy USING (id)), r AS (SELECT feature, {AVGRANK.format(k='feature', x='m')} AS rx, {AVGRANK.format(k='feature', x='y')} AS ry FROM lo),
al AS (SELECT {AVGRANK.format(k='1', x='m')} AS rx, {AVGRANK.format(k='1', x='y')} AS ry FROM (SELECT id, avg(x) AS m, any_value(y) AS y FROM parts JOIN gy USING (id) GROUP BY id))
SELECT feature, {RHO.replace(', 8)', ', 6)')} AS rho, round((SELECT corr(rx, ry) FROM al) - corr(rx, ry), 6) AS "drop" FROM r GROUP BY feature""")
def e25_feature_importance(i):
    return rounded(evaluate.feature_importance(*parts_of(i)), "rho", "drop", digits=6)


@query(PARTS + f""", d AS (SELECT feature, CASE WHEN feature < 'f3' THEN 'low' WHEN feature < 'f9' THEN 'high' ELSE 'one' END AS domain FROM (SELECT DISTINCT feature FROM parts)), m AS (SELECT domain, id, avg(x) AS m, any_value(y) AS y FROM parts JOIN d USING (feature) JOIN gy USING (id) GROUP BY domain, id),
r AS (SELECT domain, {AVGRANK.format(k='domain', x='m')} AS rx, {AVGRANK.format(k='domain', x='y')} AS ry FROM m) SELECT domain, {RHO.replace(', 8)', ', 6)')} AS rho, (SELECT count(*) FROM d x WHERE x.domain = r.domain) AS n_features FROM r WHERE domain <> 'one' GROUP BY domain""")
def e26_domain_subset_score(i):
    parts, gold = parts_of(i)
    domains = parts.select("feature").distinct().withColumn("domain", F.expr("CASE WHEN feature < 'f3' THEN 'low' WHEN feature < 'f9' THEN 'high' ELSE 'one' END"))
    return rounded(evaluate.domain_subset_score(parts, domains, gold), "rho", digits=6)


@query("SELECT l_returnflag AS k, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std, count(x) AS n FROM (SELECT l_returnflag, CASE WHEN l_quantity > 3 THEN l_tax END AS x FROM lineitem) GROUP BY l_returnflag")
def e27_aggregate_over_seeds(i):
    rows = i.table("lineitem").selectExpr("l_returnflag AS k", "CASE WHEN l_quantity > 3 THEN l_tax END AS x")
    return rounded(evaluate.aggregate_over_seeds(rows, "k"), "mean", "std")


@query("""SELECT a.entity, round(min(2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(b.latitude - a.latitude) / 2) ** 2 + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin(radians(b.longitude - a.longitude) / 2) ** 2)))), 4) AS km
    FROM meta a JOIN meta b ON a.entity <> b.entity GROUP BY a.entity""")
def g1_min_haversine_km(i):
    return rounded(evaluate.min_haversine_km(i.meta, i.meta), "km", digits=4)


@query(""", hv AS (SELECT *, CASE WHEN r <= floor(n / 2) THEN 'context' ELSE 'target' END AS half FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n, row_number() OVER (PARTITION BY entity ORDER BY feature) AS r FROM cells) WHERE n >= 4),
g AS (SELECT a.alpha, b.least FROM (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS alpha) a CROSS JOIN (SELECT unnest([2, 300])::INT AS least) b), tot AS (SELECT alpha, least, t.entity, t.feature, t.value AS truth, k.value, round(sum(ln((coalesce(x.n, 0) + alpha) / (ci.n + alpha * k.k) + 1e-12)), 9) AS score FROM hv t JOIN hv c ON c.entity = t.entity AND c.half = 'context'
    JOIN counts ci ON ci.feature = c.feature AND ci.value = c.value JOIN book k ON k.feature = t.feature LEFT JOIN cooc x ON x.fi = c.feature AND x.vi = c.value AND x.fj = k.feature AND x.vj = k.value CROSS JOIN g WHERE t.half = 'target' AND ci.n >= least GROUP BY ALL)
SELECT alpha, least, round(avg((value = truth)::INT), 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY alpha, least, entity, feature ORDER BY score DESC, value) AS r FROM tot) WHERE r = 1 GROUP BY alpha, least""")
def e14b_grid_search(i):
    from lacuna.operators import splits, stats

    halves = splits.context_target_halves(i.cells, F.lit(0))
    return rounded(evaluate.grid_search(i.cells, halves, i.book, stats.cooccurrence(i.cells), i.counts, [0.1, 0.5, 1.0], [2, 300]), "score")
