"""Queries of association and retrieval between the two databases."""

from pyspark.sql import functions as F

from lacuna.functions.scratch import written
from lacuna.operators import coding, retrieve
from lacuna.plans.registry import query

PROF = """, sh AS (SELECT DISTINCT entity FROM other), pa AS (SELECT concat_ws('=', c.feature, b.value) AS fv, c.entity, c.value = b.value AS present FROM cells c JOIN sh USING (entity) JOIN (SELECT DISTINCT feature, value FROM cells JOIN sh USING (entity)) b USING (feature)),
pb AS (SELECT concat_ws('=', c.feature, b.value) AS fv, c.entity, c.value = b.value AS present FROM other c JOIN (SELECT DISTINCT feature, value FROM other) b USING (feature)),
ct AS (SELECT a.fv AS fv_a, b.fv AS fv_b, count_if(a.present AND b.present)::BIGINT AS n11, count_if(a.present AND NOT b.present)::BIGINT AS n10, count_if(NOT a.present AND b.present)::BIGINT AS n01, count_if(NOT a.present AND NOT b.present)::BIGINT AS n00 FROM pa a JOIN pb b USING (entity) GROUP BY ALL)"""
SCORE = {
    "cosine": "coalesce(n11 / nullif(sqrt(((n11 + n10) * (n11 + n01))::DOUBLE), 0), 0)",
    "phi": "coalesce((n11 * n00 - n10 * n01) / nullif(sqrt((n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00)), 0), 0)",
    "jaccard": "coalesce(n11 / nullif(n11 + n10 + n01, 0), 0)",
    "ppmi": "CASE WHEN n11 > 0 THEN greatest(0, ln(n11 * (n11 + n10 + n01 + n00)::DOUBLE / ((n11 + n10) * (n11 + n01)))) ELSE 0 END",
    "log_odds": "ln((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5)))",
}
PHI = PROF + f", sc AS (SELECT fv_a, fv_b, round({SCORE['phi']}, 9) AS score FROM ct WHERE n11 + n10 + n01 + n00 >= 10)"


def shared_cells(i):
    return i.cells.join(i.other.select("entity").distinct(), "entity", "left_semi")


def table(i):
    return retrieve.contingency_of_cells(i.cells, i.other)


def phi(i):
    return written(retrieve.apply_kernel(table(i), retrieve.k_phi, 10).withColumn("score", F.round("score", 9)), "phi")


@query(PROF + "SELECT * FROM ct")
def r0_contingency(i):
    return table(i)


def register(no: int, name: str) -> None:
    @query(PROF + f"SELECT fv_a, fv_b, round({SCORE[name]}, 7) AS score FROM ct WHERE n11 + n10 + n01 + n00 >= 5")
    def kernel_query(i):
        return retrieve.apply_kernel(table(i), retrieve.KERNELS[name]).withColumn("score", F.round("score", 7))

    from lacuna.plans.registry import ORACLES, QUERIES

    QUERIES[f"r{no}_{name}"] = QUERIES.pop("kernel_query")
    ORACLES[f"r{no}_{name}"] = ORACLES.pop("kernel_query")


for n, k in ((1, "cosine"), (2, "phi"), (3, "jaccard"), (4, "ppmi"), (4, "log_odds")):
    register(n, k)


@query(PROF + f"SELECT q.fv AS fv_a, c.fv AS fv_b, coalesce(round(CASE WHEN n11 + n10 + n01 + n00 >= 1350 THEN {SCORE['phi']} END, 8), -2) AS score FROM (SELECT DISTINCT fv FROM pa WHERE fv LIKE 's%') q CROSS JOIN (SELECT DISTINCT fv FROM pb) c LEFT JOIN ct ON fv_a = q.fv AND fv_b = c.fv")
def r5_rank_candidates(i):
    pairs = written(table(i).filter("fv_a LIKE 's%'"), "pairs")
    candidates = written(i.other.select(coding.value_label("feature", "value").alias("fv_b")).distinct(), "candidates")
    out = retrieve.rank_candidates(pairs, pairs.select("fv_a").distinct(), candidates, retrieve.k_phi, 1350)
    return out.withColumn("score", F.round("score", 8))


SOFT = """, ev AS (SELECT vec_id AS entity, embedding::DOUBLE[] AS vec FROM embeddings), vv AS (SELECT feature, value, embedding::DOUBLE[] AS vec FROM book JOIN embeddings ON vec_id = gid + 200),
sf AS (SELECT entity, feature, value, exp(3 * list_inner_product(ev.vec, vv.vec)) AS e FROM ev CROSS JOIN vv), sp AS (SELECT entity, feature, value, e / sum(e) OVER (PARTITION BY entity, feature) AS p FROM sf)"""


def soft(i):
    entities = i.vecs.select(F.col("id").alias("entity"), "vec")
    return retrieve.predicted_profiles(entities, values_of(i), 3.0)


def values_of(i):
    return i.book.join(i.vecs, F.col("gid") + 200 == F.col("id")).select("feature", "value", "vec")


@query(SOFT + "SELECT entity, feature, value, round(p, 6) AS p FROM sp")
def r6_predicted_profiles(i):
    return soft(i).withColumn("p", F.round("p", 6))


@query(SOFT + "SELECT 'adj=red & size=s1' AS label, entity, round(a.p * b.p, 6) AS p FROM sp a JOIN sp b USING (entity) WHERE a.feature = 'adj' AND a.value = 'red' AND b.feature = 'size' AND b.value = 's1'")
def r7_conjunction_profile(i):
    labels = i.spark.createDataFrame([("adj=red & size=s1",), ("adj=red & none=x",)], "label string")
    p = soft(i).select(coding.value_label("feature", "value").alias("fv"), "entity", "p")
    return retrieve.conjunction_profile(labels, p).withColumn("p", F.round("p", 6))


@query(PHI + "SELECT fv_a, fv_b, rank FROM (SELECT *, rank() OVER (PARTITION BY fv_a ORDER BY score DESC)::INT AS rank FROM sc) WHERE fv_b = 'flag=A'")
def r8_rank_of(i):
    scores = phi(i)
    return retrieve.rank_of(scores, scores.select("fv_a").distinct().withColumn("fv_b", F.lit("flag=A")))


@query(PHI + "SELECT fv_a, fv_b, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY fv_a ORDER BY score DESC, fv_b)::INT AS rank FROM sc) WHERE rank <= 3")
def r9_top_k_per_query(i):
    return retrieve.top_k_per_query(phi(i), 3)


@query(PHI + """, rk AS (SELECT fv_a AS query, split_part(fv_a, '=', 1) AS domain, CASE WHEN r < 9 THEN r END AS rank FROM (SELECT *, rank() OVER (PARTITION BY fv_a ORDER BY score DESC)::INT AS r FROM sc) WHERE fv_b LIKE 'flag%'), b AS (SELECT query, domain, min(rank) AS rank FROM rk GROUP BY ALL)
SELECT domain, """ + ", ".join(f"round(avg(coalesce((rank <= {k})::INT, 0)), 8) AS recall_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1 / rank, 0)), 8) AS mrr, median(rank)::DOUBLE AS median, count(*) AS n FROM b GROUP BY ROLLUP (domain)")
def r10_recall_mrr(i):
    scores = phi(i)
    ranks = retrieve.rank_of(scores, scores.filter("fv_b LIKE 'flag%'"))
    rows = ranks.select(F.col("fv_a").alias("query"), F.substring_index("fv_a", "=", 1).alias("domain"), F.when(F.col("rank") < 9, F.col("rank")).alias("rank"))
    out = retrieve.recall_mrr(rows)
    return out.withColumns({c: F.round(c, 8) for c in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr")})


PREV = PROF + ", fa AS (SELECT fv, family, avg(present::INT) AS share, count(*) AS c FROM pa JOIN meta USING (entity) GROUP BY ALL HAVING count(*) >= {c}), fb AS (SELECT fv, family, avg(present::INT) AS share FROM pb JOIN meta USING (entity) GROUP BY ALL HAVING count(*) >= {c})"


def prevalences(i, least):
    return tuple(retrieve.prevalence_of_cells(cells, i.meta, least_coded=least) for cells in (shared_cells(i), i.other))


@query(PREV.format(c=1) + """SELECT fv_a, fv_b, round(coalesce(d / nullif(na * nb, 0), 0), 7) AS score FROM (SELECT a.fv AS fv_a, b.fv AS fv_b, sum(a.share * b.share) AS d FROM fa a JOIN fb b USING (family) GROUP BY ALL)
    JOIN (SELECT fv AS fv_a, sqrt(sum(share ** 2)) AS na FROM fa GROUP BY fv) USING (fv_a) JOIN (SELECT fv AS fv_b, sqrt(sum(share ** 2)) AS nb FROM fb GROUP BY fv) USING (fv_b)""")
def r11_family_prevalence_cosine(i):
    return retrieve.prevalence_cosine(*prevalences(i, 1)).withColumn("score", F.round("score", 7))


@query(PREV.format(c=225) + "SELECT a.fv AS fv_a, b.fv AS fv_b, round(coalesce(sum(a.share * b.share) / nullif(sqrt(sum(a.share ** 2) * sum(b.share ** 2)), 0), 0), 7) AS score FROM fa a JOIN fb b USING (family) GROUP BY ALL HAVING count(*) >= 3")
def r11b_group_prevalence_cosine(i):
    return retrieve.common_cosine(*prevalences(i, 225), "family", "share", 3).withColumn("score", F.round("score", 7))


@query(PROF + """, v AS (SELECT vec_id AS entity, embedding::DOUBLE[] AS vec FROM embeddings), e AS (SELECT entity, k, vec[k] AS x FROM v CROSS JOIN range(1, 65) r(k)), ca AS (SELECT fv, k, avg(x) AS x, count(*) AS n FROM pa JOIN e USING (entity) WHERE present GROUP BY fv, k HAVING count(*) >= 3), cb AS (SELECT fv, k, avg(x) AS x FROM pb JOIN e USING (entity) WHERE present GROUP BY fv, k HAVING count(*) >= 3)
SELECT a.fv AS fv_a, b.fv AS fv_b, round(sum(a.x * b.x) / sqrt(sum(a.x ** 2) * sum(b.x ** 2)), 6) AS score FROM ca a JOIN cb b USING (k) GROUP BY ALL""")
def r12_centroid_cosine(i):
    held = (cells.select(coding.value_label("feature", "value").alias("fv"), "entity", F.lit(True).alias("present")) for cells in (shared_cells(i), i.other))
    return retrieve.centroid_cosine(*held, i.vecs.select(F.col("id").alias("entity"), "vec")).withColumn("score", F.round("score", 6))


@query(PHI + """, x AS (SELECT fv_a, fv_b, row_number() OVER (PARTITION BY fv_a ORDER BY score DESC, fv_b) AS r FROM sc), y AS (SELECT fv_a, fv_b, row_number() OVER (PARTITION BY fv_b ORDER BY score DESC, fv_a) AS r FROM sc)
SELECT fv_a, fv_b, (x.r + y.r) / 2 AS mean_rank, split_part(fv_a, '=', 1) AS domain FROM x JOIN y USING (fv_a, fv_b) WHERE x.r <= 5 AND y.r <= 5 AND fv_a <> 'adj=red' ORDER BY mean_rank, fv_a, fv_b LIMIT 50""")
def r13_discover(i):
    scores = phi(i)
    back = scores.select(F.col("fv_b").alias("fv_a"), F.col("fv_a").alias("fv_b"), "score")
    domains = scores.select("fv_a", F.substring_index("fv_a", "=", 1).alias("domain")).distinct()
    return retrieve.discover(scores, back, scores.filter("fv_a = 'adj=red'"), domains)


@query("SELECT l_suppkey AS k, round_even(avg(l_linenumber), 0)::INT AS rank FROM lineitem GROUP BY l_suppkey")
def r14_multi_seed_rank(i):
    return retrieve.multi_seed_rank(i.table("lineitem").selectExpr("l_suppkey AS k", "l_linenumber AS rank"), "k")


@query(SOFT + ", l AS (SELECT concat_ws('=', feature, value) AS fv, entity, p FROM sp) SELECT a.fv AS fv_a, b.fv AS fv_b, round(CASE WHEN count(*) >= 60 THEN sum(a.p * b.p) / sqrt(sum(a.p ** 2) * sum(b.p ** 2)) ELSE -2 END, 6) AS score FROM l a JOIN l b USING (entity) GROUP BY ALL")
def r15_profile_cosine_common(i):
    p = soft(i).select(coding.value_label("feature", "value").alias("fv"), "entity", "p")
    return retrieve.common_cosine(p, p, "entity", "p", 60, -2.0).withColumn("score", F.round("score", 6))


@query(PHI + "SELECT fv_a, fv_b FROM sc WHERE score > 0 AND fv_a LIKE 's%'")
def r16_evaluable_by_all(i):
    scores = phi(i)
    return retrieve.evaluable_by_all(scores.select("fv_a", "fv_b"), scores.filter("score > 0"), scores.filter("fv_a LIKE 's%'"))


@query("SELECT p_brand AS feature, CASE WHEN CAST(substr(p_brand, 7) AS INT) BETWEEN 1 AND 9 THEN 'low' WHEN CAST(substr(p_brand, 7) AS INT) BETWEEN 10 AND 19 THEN 'mid' END AS domain FROM part GROUP BY p_brand")
def r17_chapter_domain(i):
    bounds = i.spark.createDataFrame([(1, 9, "low"), (10, 19, "mid")], "low int, high int, domain string")
    return retrieve.chapter_domain("feature", bounds)(i.table("part").select(F.col("p_brand").alias("feature")).distinct())


@query(SOFT + """, l AS (SELECT concat_ws('=', feature, value) AS fv, entity, p FROM sp), s AS (SELECT a.fv AS fv_a, b.fv AS fv_b, round(sum(a.p * b.p) / sqrt(sum(a.p ** 2) * sum(b.p ** 2)), 6) AS score FROM l a JOIN l b USING (entity) WHERE a.fv LIKE 'adj%' AND b.fv LIKE 'noun%' GROUP BY ALL)
SELECT fv_a, fv_b, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY fv_a ORDER BY score DESC, fv_b)::INT AS rank FROM s) WHERE rank <= 3""")
def r18_profile_retrieval(i):
    p = soft(i).select(coding.value_label("feature", "value").alias("fv"), "entity", "p")
    scores = retrieve.common_cosine(p.filter("fv LIKE 'adj%'"), p.filter("fv LIKE 'noun%'"), "entity", "p").withColumn("score", F.round("score", 6))
    return retrieve.top_k_per_query(scores, 3)
