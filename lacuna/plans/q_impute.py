"""Queries of the imputers."""

from pyspark.sql import functions as F

from lacuna.functions.scratch import written
from lacuna.operators import impute, leave_out, stats
from lacuna.plans.q_stats import MI, SOURCES, mi_and_entropy, sources
from lacuna.plans.registry import query

R = "round(score, 8) AS score"
BEST = "SELECT entity, feature, value, score FROM (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY score DESC, value) AS r FROM {t}) WHERE r = 1"
ELSE = "SELECT entity, feature, coalesce(a.value, f.value) AS value, round(CASE WHEN a.value IS NOT NULL THEN a.score ELSE {s} END, 8) AS score FROM blanks LEFT JOIN ({t}) a USING (entity, feature) JOIN freqs f USING (feature)"
IDF = ", idf AS (SELECT feature, ln((SELECT count(DISTINCT entity) FROM cells) / (1 + count(DISTINCT entity))) AS idf FROM cells GROUP BY feature)"
KNN = """, few AS (SELECT * FROM blanks), near AS (SELECT entity, other, score FROM (SELECT a.entity, b.entity AS other, {w} AS score, row_number() OVER (PARTITION BY a.entity ORDER BY {w} DESC, b.entity) AS r
    FROM cells a JOIN cells b USING (feature, value) {j} WHERE a.entity <> b.entity AND a.entity IN (SELECT entity FROM few) GROUP BY a.entity, b.entity HAVING {w} > 0) WHERE r <= 5),
votes AS (SELECT few.entity, few.feature, c.value, count(*) AS n, sum(score) AS weight FROM few JOIN near USING (entity) JOIN cells c ON c.entity = near.other AND c.feature = few.feature GROUP BY ALL)"""
COND = """, ctx AS (SELECT b.entity, b.feature, k.value, ln((coalesce(x.n, 0) + 0.5) / (ci.n + 0.5 * k.k) + 1e-12) AS term FROM blanks b JOIN cells c ON c.entity = b.entity AND c.feature <> b.feature
    JOIN counts ci ON ci.feature = c.feature AND ci.value = c.value AND ci.n >= 5 JOIN book k ON k.feature = b.feature LEFT JOIN cooc x ON x.fi = c.feature AND x.vi = c.value AND x.fj = b.feature AND x.vj = k.value)"""
PPMI = MI + """, sym AS (SELECT fi, fj, nmi FROM nmi WHERE nmi > 0 UNION ALL SELECT fj, fi, nmi FROM nmi WHERE nmi > 0),
rk AS (SELECT b.entity, b.feature, c.feature AS fi, c.value AS vi, s.nmi, ci.n AS n_i, row_number() OVER (PARTITION BY b.entity, b.feature ORDER BY s.nmi DESC, c.feature) AS r FROM blanks b JOIN cells c ON c.entity = b.entity
    JOIN sym s ON s.fi = c.feature AND s.fj = b.feature JOIN counts ci ON ci.feature = c.feature AND ci.value = c.value AND ci.n >= 5),
wt AS (SELECT *, nmi / sum(nmi) OVER (PARTITION BY entity, feature) AS w FROM rk WHERE r <= 3),
lg AS (SELECT wt.entity, wt.feature, k.value, sum(coalesce(w * greatest(0, ln((x.n + 0.5) / (n_i + 0.5 * k.k) / p.p)), 0)) AS logit FROM wt JOIN book k ON k.feature = wt.feature JOIN p ON p.feature = k.feature AND p.value = k.value
    LEFT JOIN cooc x ON x.fi = wt.fi AND x.vi = wt.vi AND x.fj = wt.feature AND x.vj = k.value AND x.n >= 2 GROUP BY ALL),
ppmi AS (SELECT b.entity, b.feature, p.value, coalesce(exp(logit) / sum(exp(logit)) OVER (PARTITION BY b.entity, b.feature), p.p) AS score FROM blanks b JOIN p USING (feature) LEFT JOIN lg ON lg.entity = b.entity AND lg.feature = b.feature AND lg.value = p.value)"""
AGREE = """, agr AS (SELECT entity, feature, value AS plurality, n AS n_agree, n / ns AS share, ns AS n_systems, nv AS n_values FROM (SELECT *, (sum(n) OVER w)::BIGINT AS ns, count(*) OVER w AS nv, row_number() OVER (PARTITION BY entity, feature ORDER BY n DESC, value) AS r
    FROM (SELECT entity, feature, value, count(*) AS n FROM preds GROUP BY ALL) WINDOW w AS (PARTITION BY entity, feature)) WHERE r = 1)"""


def rounded(df, column="score"):
    return df.withColumn(column, F.round(column, 8))


@query("SELECT entity, feature, value, round(score, 8) AS score FROM blanks JOIN freqs USING (feature)")
def i1_freq(i):
    return rounded(impute.impute_freq(i.cells, i.blanks))


@query(ELSE.format(t="SELECT b.entity, b.feature, g.value, c.n::DOUBLE AS score FROM blanks b JOIN meta m USING (entity) JOIN genus_mode g ON g.genus = m.genus AND g.feature = b.feature JOIN (SELECT genus, feature, value, count(*) AS n FROM cells JOIN meta USING (entity) GROUP BY ALL) c ON c.genus = g.genus AND c.feature = g.feature AND c.value = g.value", s="f.score"))
def i2_group_majority(i):
    return rounded(impute.impute_group_majority(i.cells, i.blanks, i.meta))


@query(KNN.format(w="count(*)", j="") + ELSE.format(t="SELECT * FROM (" + BEST.format(t="(SELECT *, n::DOUBLE AS score FROM votes)") + ")", s="f.score"))
def i3_knn(i):
    return rounded(impute.impute_knn(i.cells, i.blanks))


@query(IDF + KNN.format(w="round(sum(idf), 9)", j="JOIN idf USING (feature)") + ELSE.format(t="SELECT * FROM (" + BEST.format(t="(SELECT *, n::DOUBLE AS score FROM votes)") + ")", s="f.score"))
def i4_idf_knn(i):
    return rounded(impute.impute_knn(i.cells, i.blanks, weights=stats.idf(i.cells)))


@query(IDF + KNN.format(w="round(sum(idf), 9)", j="JOIN idf USING (feature)") + """, d AS (SELECT b.entity, b.feature, p.value, p.p, coalesce(weight, 0) AS weight, coalesce(sum(n) OVER w, 0) AS support, sum(weight) OVER w AS total FROM blanks b JOIN p USING (feature)
    LEFT JOIN votes v ON v.entity = b.entity AND v.feature = b.feature AND v.value = p.value WINDOW w AS (PARTITION BY b.entity, b.feature))
SELECT entity, feature, value, round(p / (1 + support) + (1 - 1 / (1 + support)) * coalesce(weight / nullif(total, 0), 0), 6) AS score FROM d""")
def i4b_idf_knn_distribution(i):
    return impute.idf_knn_distribution(i.cells, i.blanks, i.p, stats.idf(i.cells)).withColumn("score", F.round("score", 6))


VEC_KNN = """, b AS (SELECT * FROM blanks JOIN meta USING (entity)), v AS (SELECT vec_id AS entity, embedding::DOUBLE[] AS vec FROM embeddings), pr AS (SELECT b.entity, b.feature, c.value, row_number() OVER (PARTITION BY b.entity, b.feature ORDER BY list_distance(v1.vec, v2.vec), c.entity) AS r
    FROM b JOIN v v1 ON v1.entity = b.entity JOIN cells c ON c.feature = b.feature JOIN meta m2 ON m2.entity = c.entity AND m2.genus <> b.genus JOIN v v2 ON v2.entity = c.entity),
vt AS (SELECT entity, feature, value, count(*)::DOUBLE AS score FROM pr WHERE r <= 3 GROUP BY ALL)
"""


@query(VEC_KNN + ELSE.format(t=BEST.format(t="vt"), s="f.score"))
def i5_vector_knn(i):
    return rounded(impute.impute_vector_knn(i.cells, i.blanks, i.vecs.select(F.col("id").alias("entity"), "vec"), i.meta, 3))


def scores_of(i):
    return impute.context_scores(i.cells, i.blanks, i.book, stats.cooccurrence(i.cells), i.counts, 0.5, 5)


@query(COND + ELSE.format(t=BEST.format(t="(SELECT entity, feature, value, round(sum(term), 9) AS score FROM ctx GROUP BY ALL)"), s="f.score"))
def i6_condprob(i):
    return rounded(impute.impute_condprob(i.cells, i.blanks, i.book, stats.cooccurrence(i.cells), i.counts))


@query(COND + ", pri AS (SELECT entity, feature, value, avg(term) AS mean FROM ctx GROUP BY ALL), t AS (SELECT b.entity, b.feature, p.value, round(ln(p.p + 1e-12) + 0.5 * coalesce(mean, 0), 8) AS score FROM blanks b JOIN p USING (feature) LEFT JOIN pri ON pri.entity = b.entity AND pri.feature = b.feature AND pri.value = p.value) " + BEST.format(t="t"))
def i7_rerank_with_prior(i):
    scores = i.blanks.join(i.p, "feature").withColumnRenamed("p", "score")
    return rounded(impute.rerank_with_prior(scores, scores_of(i), 0.5))


def ppmi(i):
    return impute.ppmi_expert(i.cells, i.blanks, i.book, stats.cooccurrence(i.cells), i.counts, i.p, stats.nmi(*mi_and_entropy(i)), top_k=3)


@query(PPMI + "SELECT entity, feature, value, round(score, 7) AS score FROM ppmi")
def i8_ppmi_expert(i):
    return ppmi(i).withColumn("score", F.round("score", 7))


@query(PPMI + """, vv AS (SELECT b.feature, b.value, e.embedding::DOUBLE[] AS vec FROM book b JOIN embeddings e ON e.vec_id = b.gid), sym2 AS (SELECT fi, fj, nmi FROM nmi UNION ALL SELECT fj, fi, nmi FROM nmi),
near AS (SELECT s.entity, s.feature, s.value, sum(nmi * list_cosine_similarity(v1.vec, v2.vec)) / nullif(sum(nmi), 0) AS near FROM ppmi s JOIN vv v1 USING (feature, value) JOIN cells c ON c.entity = s.entity JOIN vv v2 ON v2.feature = c.feature AND v2.value = c.value
    JOIN sym2 ON sym2.fi = c.feature AND sym2.fj = s.feature GROUP BY ALL)
SELECT s.entity, s.feature, s.value, round(score + 0.2 * coalesce(near, 0), 6) AS score FROM ppmi s LEFT JOIN near USING (entity, feature, value)""")
def i9_ppmi_plus_vectors(i):
    vectors = i.book.join(i.vecs, i.book.gid == F.col("id")).select("feature", "value", "vec")
    return impute.add_vectors(ppmi(i), i.cells, vectors, stats.nmi(*mi_and_entropy(i)), 0.2).withColumn("score", F.round("score", 6))


@query(PPMI + ", t AS (SELECT entity, feature, value, round(0.7 * ln(s.score + 1e-12) + 0.3 * ln(p.p + 1e-12), 8) AS score FROM ppmi s JOIN p USING (feature, value)) " + BEST.format(t="t"))
def i10_log_linear_mixture(i):
    marginal = i.blanks.join(i.p, "feature").select(F.lit("marginal").alias("system"), "entity", "feature", "value", F.col("p").alias("score"))
    scores = ppmi(i).withColumn("system", F.lit("ppmi")).unionByName(marginal)
    weights = i.spark.createDataFrame([("ppmi", 0.7), ("marginal", 0.3)], "system string, weight double")
    return rounded(impute.log_linear_mixture(scores, weights))


CONF_ROWS = SOURCES + ", rows AS (SELECT b.entity, b.feature AS target, c.source, c.sv, c.tv, round(c.score, 9) AS score, c.n_st FROM blanks b JOIN sources s USING (entity) JOIN conf c ON c.source = s.feature AND c.sv = s.value AND c.target = b.feature)"


@query(CONF_ROWS + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, target ORDER BY best DESC, source) AS r FROM (SELECT entity, target, source, max(score) AS best FROM rows GROUP BY ALL)) WHERE r <= 5),
t AS (SELECT entity, target AS feature, tv AS value, sum(round(score * 1e9)::BIGINT) / 1e9::DOUBLE AS score FROM rows JOIN top USING (entity, target, source) GROUP BY ALL), bt AS (""" + BEST.format(t="t") + """ AND score <> 0)
SELECT entity, feature, coalesce(a.value, f.value) AS value, coalesce(a.score, 0.0::DOUBLE) AS score FROM blanks LEFT JOIN bt a USING (entity, feature) JOIN freqs f USING (feature)""")
def i11_log_confidence(i):
    own = sources(i)
    conf = stats.log_confidence(stats.source_target_counts(own, i.cells), i.book).withColumn("score", F.round("score", 9))
    return impute.impute_log_confidence(own, i.blanks, conf, i.cells)


@query(CONF_ROWS + """, t AS (SELECT r.entity, r.target AS feature, r.tv AS value, coalesce(j.n_joint / r.n_st, 0) AS score FROM (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY entity, target ORDER BY score DESC, source, tv) = 1) r LEFT JOIN joint j USING (source, sv, target, tv)) """ + ELSE.format(t="SELECT * FROM t", s="0.0"))
def i12_best_source(i):
    own = sources(i)
    counts = stats.source_target_counts(own, i.cells)
    conf = stats.log_confidence(counts, i.book).withColumn("score", F.round("score", 9))
    return rounded(impute.impute_best_source(own, i.blanks, counts, conf, i.cells))


@query("""SELECT a.entity, a.feature, CASE WHEN a.score > 0.4 AND b.score < 0.6 AND a.entity % 2 = 0 THEN a.value ELSE b.value END AS value, a.value <> b.value AS disagree, a.score > 0.4 AND b.score < 0.6 AND a.entity % 2 = 0 AS from_a
    FROM preds a JOIN preds b USING (entity, feature) WHERE a.system = 'genus' AND b.system = 'family'""")
def i13_merge_by_threshold(i):
    a = i.preds.filter("system = 'genus'").withColumn("score", F.when(F.col("entity") % 2 == 0, F.col("score")).otherwise(0.0))
    return impute.merge_by_threshold(a, i.preds.filter("system = 'family'"), 0.4, 0.6)


@query(", t AS (SELECT entity, feature, value, count(*)::DOUBLE AS score FROM preds GROUP BY ALL) " + BEST.format(t="t"))
def i14_majority_vote(i):
    return impute.majority_vote(i.preds)


@query(AGREE + "SELECT entity, feature, plurality, n_agree, round(share, 8) AS share, n_systems, n_values FROM agr")
def i15_agreement_features(i):
    return rounded(impute.agreement_features(i.preds), "share")


@query("SELECT a.entity, a.feature, a.system AS a, b.system AS b, a.value = b.value AS agree FROM preds a JOIN preds b USING (entity, feature) WHERE a.system < b.system")
def i15b_pairwise_agreement(i):
    return impute.pairwise_agreement(i.preds)


@query(AGREE + "SELECT g.entity, g.feature, CASE WHEN n_agree >= 2 THEN plurality ELSE coalesce(CASE WHEN m.genus < 'Brand#2' THEN f.value ELSE s.value END, plurality) END AS value FROM agr g JOIN meta m USING (entity) LEFT JOIN (SELECT * FROM preds WHERE system = 'family') f USING (entity, feature) LEFT JOIN (SELECT * FROM preds WHERE system = 'genus') s USING (entity, feature)")
def i16_agreement_heuristic(i):
    groups = i.meta.select(F.col("genus").alias("group")).distinct()
    order = groups.select("group", F.explode(F.when(F.col("group") < "Brand#2", F.array(F.lit("family"), F.lit("genus"))).otherwise(F.array(F.lit("genus"), F.lit("family")))).alias("system"))
    place = F.when((F.col("group") < "Brand#2") == (F.col("system") == "family"), 0).otherwise(1)
    return impute.agreement_heuristic(i.preds, i.meta, order.withColumn("place", place), 2)


def scored(i):
    gold = i.gold.withColumnRenamed("value", "truth")
    return i.preds.join(gold, ["entity", "feature"]).withColumn("right", F.col("value") == F.col("truth")).join(i.meta.select("entity", "genus"), "entity")


BEST_SYSTEM = """, sc AS (SELECT p.*, p.value = g.value AS ok, m.genus FROM preds p JOIN gold g USING (entity, feature) JOIN meta m USING (entity)), bs AS (SELECT {k}, system, acc FROM (SELECT {k}, system, avg(ok::INT) AS acc, row_number() OVER (PARTITION BY {k} ORDER BY avg(ok::INT) DESC, system) AS r FROM sc GROUP BY {k}, system HAVING count(*) >= 5) WHERE r = 1)
SELECT b.entity, b.feature, coalesce(p.value, f.value, q.value) AS value, coalesce(p.score, f.score, q.score) AS score FROM blanks b JOIN meta m USING (entity) LEFT JOIN bs ON {j} LEFT JOIN preds p ON p.entity = b.entity AND p.feature = b.feature AND p.system = coalesce(bs.system, 'freq')
    LEFT JOIN preds f ON f.entity = b.entity AND f.feature = b.feature AND f.system = 'freq' JOIN freqs q ON q.feature = b.feature"""


@query(BEST_SYSTEM.format(k="feature", j="bs.feature = b.feature"))
def i17_best_system_per_feature(i):
    return impute.apply_best_system(i.preds, impute.best_system(scored(i), "feature"), i.blanks, "freq", impute.impute_freq(i.cells, i.blanks), "feature")


@query(BEST_SYSTEM.format(k="genus", j="bs.genus = m.genus"))
def i18_best_system_per_group(i):
    blanks = i.blanks.join(i.meta.select("entity", "genus"), "entity")
    return impute.apply_best_system(i.preds, impute.best_system(scored(i), "genus"), blanks, "freq", impute.impute_freq(i.cells, i.blanks), "genus")


@query(""", two AS (SELECT *, lead(p) OVER (PARTITION BY feature ORDER BY p DESC, value) AS nxt, row_number() OVER (PARTITION BY feature ORDER BY p DESC, value) AS r FROM p), sure AS (SELECT entity, feature, value, p - coalesce(nxt, 0) AS margin FROM blanks JOIN two USING (feature) WHERE r = 1 AND p - coalesce(nxt, 0) >= 0.01),
top AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY margin DESC, feature) AS r FROM sure) SELECT entity, feature, value, false AS pseudo FROM cells UNION ALL SELECT entity, feature, value, true FROM top WHERE r <= 1""")
def i19_confident_pseudo_labels(i):
    scores = i.blanks.join(i.p, "feature").withColumnRenamed("p", "score")
    return impute.confident_pseudo_labels(scores, i.cells, 0.01, 1)


@query(""", y AS (SELECT entity, 'size' AS target, p_size::DOUBLE AS y, family FROM meta JOIN part ON p_partkey = entity) SELECT entity, target, round(o, 8) AS overall, round(coalesce(g, o), 8) AS by_group, 0.5::DOUBLE AS constant FROM y
    CROSS JOIN (SELECT avg(y) AS o FROM y WHERE entity % 4 <> 0) LEFT JOIN (SELECT family, avg(y) AS g FROM y WHERE entity % 4 <> 0 GROUP BY family) USING (family) WHERE entity % 4 = 0""")
def i20_mean_targets(i):
    y = i.meta.join(i.table("part"), F.col("entity") == F.col("p_partkey")).select("entity", F.lit("size").alias("target"), F.col("p_size").cast("double").alias("y"), "family")
    return rounded(rounded(impute.mean_targets(y.filter("entity % 4 <> 0"), y.filter("entity % 4 = 0")), "overall"), "by_group")


@query(KNN.format(w="count(*)", j="") + """, v AS (SELECT vec_id AS other, embedding[1]::DOUBLE AS x FROM embeddings), own AS (SELECT entity, avg(x) AS x FROM near JOIN v USING (other) GROUP BY entity)
SELECT DISTINCT b.entity, round(coalesce(own.x, (SELECT avg(x) FROM v)), 8) AS first FROM blanks b LEFT JOIN own USING (entity)""")
def i21_warm_start_vector(i):
    near = impute.neighbours(i.cells, i.blanks, 5)
    out = impute.warm_start_vector(near, i.vecs.select(F.col("id").alias("entity"), "vec"), i.blanks)
    return out.select("entity", F.round(F.element_at("vec", 1), 8).alias("first"))


@query()
def i22_factorise(i):
    return impute.impute_factorised(i.cells, i.blanks, i.book)


@query(AGREE + "SELECT b.entity, b.feature, CASE WHEN n_agree >= 2 THEN plurality ELSE b.value END AS value FROM preds b LEFT JOIN agr USING (entity, feature) WHERE b.system = 'freq'")
def i24_override_on_agreement(i):
    return impute.override_on_agreement(i.preds.filter("system = 'freq'"), i.preds, 2)


def candidates(i):
    entropy = mi_and_entropy(i)[1]
    rows = impute.candidate_rows(i.cells, i.blanks, i.book, i.p, entropy, i.preds, i.meta, ["freq", "genus", "family"], ["Brand#1", "Brand#2"])
    truth = i.gold.select("entity", "feature", F.col("value").alias("truth"))
    return rows.join(truth, ["entity", "feature"]).withColumn("right", (F.col("value") == F.col("truth")).cast("int")).drop("truth")


@query(MI + AGREE + """, said AS (SELECT entity, feature, value, count(*) AS v, avg(score) AS s FROM preds GROUP BY ALL), gs AS (SELECT genus, feature, value, n / sum(n) OVER (PARTITION BY genus, feature) AS gsh FROM (SELECT genus, feature, value, count(*) AS n FROM cells JOIN meta USING (entity) GROUP BY genus, feature, value)),
fs AS (SELECT family, feature, value, n / sum(n) OVER (PARTITION BY family, feature) AS fsh FROM (SELECT family, feature, value, count(*) AS n FROM cells JOIN meta USING (entity) GROUP BY family, feature, value)), kn AS (SELECT entity, count(*) AS n FROM cells GROUP BY entity), sy AS (SELECT entity, feature, max(value) FILTER (system = 'freq') AS a, max(value) FILTER (system = 'genus') AS b, max(value) FILTER (system = 'family') AS c FROM preds GROUP BY ALL),
sn AS (SELECT entity, feature, v FROM (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY v DESC, value) AS r FROM said) WHERE r = 2), ne AS (SELECT feature, count(DISTINCT entity) AS n FROM cells GROUP BY feature),
km AS (SELECT a.entity, min(2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(b.latitude - a.latitude) / 2) ** 2 + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin(radians(b.longitude - a.longitude) / 2) ** 2)))) AS km FROM meta a JOIN meta b ON a.entity <> b.entity AND b.entity IN (SELECT entity FROM cells) GROUP BY a.entity)
SELECT b.entity, b.feature, k.value, round(p.p, 7) AS p, round(h.h, 7) AS h, k.k::DOUBLE AS k, coalesce(said.v, 0)::DOUBLE AS n_votes, round(coalesce(said.s, 0), 7) AS mean_score, agr.n_agree::DOUBLE AS n_agree, (k.value = agr.plurality)::INT::DOUBLE AS is_plurality,
    round(coalesce(gsh, 0), 7) AS genus_share, round(coalesce(fsh, 0), 7) AS family_share, coalesce(kn.n, 0)::DOUBLE AS n_known, round(km.km, 4) AS km, 1.0::DOUBLE AS genus_known, 1.0::DOUBLE AS family_known, (m.genus IN ('Brand#1', 'Brand#2'))::INT::DOUBLE AS controlled, ne.n::DOUBLE AS n_entities, mk.vi::DOUBLE AS majority_no, k.vi::DOUBLE AS value_no,
    (k.value = freq.value)::INT::DOUBLE AS is_majority, (agr.n_agree = agr.n_systems)::INT::DOUBLE AS all_agree, coalesce(sn.v, 0)::DOUBLE AS n_second, round(coalesce(said.v, 0) / agr.n_systems, 7) AS vote_share,
    coalesce(sy.a = k.value, false)::INT::DOUBLE AS said_freq, coalesce(sy.b = k.value, false)::INT::DOUBLE AS said_genus, coalesce(sy.c = k.value, false)::INT::DOUBLE AS said_family, coalesce(sy.a = agr.plurality, false)::INT::DOUBLE AS leads_freq, coalesce(sy.b = agr.plurality, false)::INT::DOUBLE AS leads_genus,
    coalesce(sy.c = agr.plurality, false)::INT::DOUBLE AS leads_family, coalesce(sy.a = sy.b, false)::INT::DOUBLE AS agree_freq_genus, coalesce(sy.a = sy.c, false)::INT::DOUBLE AS agree_freq_family, coalesce(sy.b = sy.c, false)::INT::DOUBLE AS agree_genus_family FROM blanks b JOIN book k USING (feature) JOIN p ON p.feature = k.feature AND p.value = k.value JOIN h ON h.feature = b.feature JOIN meta m ON m.entity = b.entity
    LEFT JOIN said ON said.entity = b.entity AND said.feature = b.feature AND said.value = k.value LEFT JOIN agr ON agr.entity = b.entity AND agr.feature = b.feature LEFT JOIN gs ON gs.genus = m.genus AND gs.feature = b.feature AND gs.value = k.value LEFT JOIN fs ON fs.family = m.family AND fs.feature = b.feature AND fs.value = k.value LEFT JOIN kn ON kn.entity = b.entity LEFT JOIN sy ON sy.entity = b.entity AND sy.feature = b.feature
    LEFT JOIN sn ON sn.entity = b.entity AND sn.feature = b.feature JOIN ne ON ne.feature = b.feature JOIN freq ON freq.feature = b.feature JOIN book mk ON mk.feature = b.feature AND mk.value = freq.value JOIN km ON km.entity = b.entity""")
def g2_cell_candidate_rows(i):
    rows = candidates(i).drop("genus", "right", "latitude", "longitude", "share", "n_systems", "n_values")
    return rows.withColumns({c: F.round(c, 7) for c in ("p", "h", "mean_score", "genus_share", "family_share", "vote_share")} | {"km": F.round("km", 4)})


class Stack:
    """Candidate rows of observed cells, each left out (``train``), and of the blanks (``test``), both with what the same systems say. Entities are indexed once for all systems."""

    def __init__(self, i):
        self.i = i = i.kept()
        # rows per pair of values and per feature; written, so that plans know how small they are
        self.cooc, self.idf = written(stats.cooccurrence(i.cells), "pairs"), written(stats.idf(i.cells), "idf")
        self.index = leave_out.index_of(i.cells, 5)

    def left_out(self):
        i = self.i
        return leave_out.predictions(i.cells, i.meta, i.book, self.cooc, i.counts, self.idf, index=self.index)

    def common(self):
        return self.i.book, self.i.p, stats.feature_entropy(self.i.p)

    def train(self):
        i = self.i
        known = written(self.left_out(), "left-out")
        rows = impute.candidate_rows(i.cells, i.cells, *self.common(), known, i.meta, leave_out.SYSTEMS, left_out=leave_out.own_counts(i.cells, i.meta, i.book))
        truth = i.cells.select("entity", "feature", F.col("value").alias("truth"))
        return rows.join(truth, ["entity", "feature"]).withColumn("right", (F.col("value") == F.col("truth")).cast("int")).drop("truth")

    def test(self):
        i = self.i
        said = None
        for system, rows in {
            "freq": impute.impute_freq(i.cells, i.blanks),
            "genus": impute.impute_group_majority(i.cells, i.blanks, i.meta),
            "knn": impute.impute_knn(i.cells, i.blanks, index=self.index),
            "idf_knn": impute.impute_knn(i.cells, i.blanks, weights=self.idf, index=self.index),
            "condprob": impute.impute_condprob(i.cells, i.blanks, i.book, self.cooc, i.counts),
        }.items():
            rows = rows.select(F.lit(system).alias("system"), "entity", "feature", "value", "score")
            said = rows if said is None else said.unionByName(rows)
        return impute.candidate_rows(i.cells, i.blanks, *self.common(), written(said, "said"), i.meta, leave_out.SYSTEMS)


@query("""
, lo AS (SELECT a.entity, a.feature, a.value AS own, m.genus FROM cells a JOIN meta m USING (entity)),
fr AS (SELECT entity, feature, value, n::DOUBLE / sum(n) OVER (PARTITION BY entity, feature) AS score FROM (SELECT lo.entity, lo.feature, o.value, count(*) AS n FROM lo JOIN cells o ON o.feature = lo.feature AND o.entity <> lo.entity GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY entity, feature ORDER BY n DESC, value) = 1),
ge AS (SELECT lo.entity, lo.feature, o.value, count(*)::DOUBLE AS score FROM lo JOIN cells o ON o.feature = lo.feature AND o.entity <> lo.entity JOIN meta m ON m.entity = o.entity AND m.genus = lo.genus GROUP BY ALL),
idf AS (SELECT feature, ln((SELECT count(DISTINCT entity) FROM cells) / (1 + count(DISTINCT entity))) AS idf FROM cells GROUP BY feature),
sh AS (SELECT lo.entity, lo.feature, b.entity AS other, count(*)::DOUBLE AS s1, round(sum(idf), 9) AS s2 FROM lo JOIN cells a ON a.entity = lo.entity AND a.feature <> lo.feature JOIN cells b ON b.feature = a.feature AND b.value = a.value AND b.entity <> a.entity JOIN idf ON idf.feature = a.feature GROUP BY ALL),
kn AS (SELECT n.entity, n.feature, c.value, count(*)::DOUBLE AS score FROM (SELECT * FROM sh WHERE s1 > 0 QUALIFY row_number() OVER (PARTITION BY entity, feature ORDER BY s1 DESC, other) <= 5) n JOIN cells c ON c.entity = n.other AND c.feature = n.feature GROUP BY ALL),
ik AS (SELECT n.entity, n.feature, c.value, count(*)::DOUBLE AS score FROM (SELECT * FROM sh WHERE s2 > 0 QUALIFY row_number() OVER (PARTITION BY entity, feature ORDER BY s2 DESC, other) <= 5) n JOIN cells c ON c.entity = n.other AND c.feature = n.feature GROUP BY ALL),
bk AS (SELECT *, count(*) OVER (PARTITION BY entity, feature) AS k FROM (SELECT DISTINCT lo.entity, lo.feature, o.value FROM lo JOIN cells o ON o.feature = lo.feature AND o.entity <> lo.entity) QUALIFY k >= 2),
jo AS (SELECT lo.entity, lo.feature, c.feature AS fi, o.value, count(*) AS n FROM lo JOIN cells c ON c.entity = lo.entity AND c.feature <> lo.feature JOIN cells x ON x.feature = c.feature AND x.value = c.value AND x.entity <> lo.entity JOIN cells o ON o.entity = x.entity AND o.feature = lo.feature GROUP BY ALL),
cp AS (SELECT lo.entity, lo.feature, bk.value, round(sum(ln((coalesce(jo.n, 0) + 0.5) / (ci.n + 0.5 * bk.k) + 1e-12)), 9) AS score FROM lo JOIN cells c ON c.entity = lo.entity AND c.feature <> lo.feature JOIN counts ci ON ci.feature = c.feature AND ci.value = c.value AND ci.n >= 5
    JOIN bk ON bk.entity = lo.entity AND bk.feature = lo.feature LEFT JOIN jo ON jo.entity = lo.entity AND jo.feature = lo.feature AND jo.fi = c.feature AND jo.value = bk.value GROUP BY ALL),
al AS (SELECT 'genus' AS system, * FROM ge UNION ALL SELECT 'knn', * FROM kn UNION ALL SELECT 'idf_knn', * FROM ik UNION ALL SELECT 'condprob', * FROM cp),
be AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY system, entity, feature ORDER BY score DESC, value) = 1)
SELECT s.system, fr.entity, fr.feature, coalesce(be.value, fr.value) AS value, round(coalesce(be.score, fr.score), 8) AS score FROM fr CROSS JOIN (SELECT unnest(['freq', 'genus', 'knn', 'idf_knn', 'condprob']) AS system) s
    LEFT JOIN be ON be.system = s.system AND be.entity = fr.entity AND be.feature = fr.feature""")
def i23a_leave_one_out(i):
    return rounded(Stack(i).left_out())


@query()
def i23_stack_systems(i):
    # learning reads its rows many times
    stack = Stack(i)
    return impute.stack_systems(written(stack.train(), "stack-train"), written(stack.test(), "stack-test"))


@query()
def i23b_stack_forest_cv(i):
    return impute.cross_validate_stack(written(Stack(i).train(), "stack-rows"), 2, "forest")
