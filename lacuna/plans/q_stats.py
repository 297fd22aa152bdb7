"""Queries of the statistics."""

from pyspark.sql import functions as F

from lacuna.operators import coding, stats
from lacuna.plans.registry import query

SOURCES = """, sources AS (SELECT entity, feature, value FROM cells UNION ALL SELECT entity, 'genus', genus FROM meta UNION ALL SELECT entity, 'family', family FROM meta
    UNION ALL SELECT entity, 'lat', CAST(CAST(round_even(latitude / 10, 0) * 10 AS INT) AS VARCHAR) FROM meta),
joint AS (SELECT s.feature AS source, s.value AS sv, t.feature AS target, t.value AS tv, count(*) AS n_joint FROM sources s JOIN cells t USING (entity) WHERE s.feature <> t.feature GROUP BY ALL),
stc AS (SELECT j.*, (sum(n_joint) OVER (PARTITION BY source, sv, target))::BIGINT AS n_st, c.n AS n_v, c.n_f FROM joint j
    JOIN (SELECT *, (sum(n) OVER (PARTITION BY feature))::BIGINT AS n_f FROM counts) c ON j.target = c.feature AND j.tv = c.value),
conf AS (SELECT a.source, a.sv, a.target, b.value AS tv, a.n_st, ln((coalesce(j.n_joint, 0) + 0.5) / (a.n_st + 0.5 * b.k)) - ln((coalesce(c.n, 0) + 0.5) / (a.n_f + 0.5 * b.k)) AS score
    FROM (SELECT DISTINCT source, sv, target, n_st, n_f FROM stc WHERE n_st >= 2) a JOIN book b ON b.feature = a.target
    LEFT JOIN joint j ON j.source = a.source AND j.sv = a.sv AND j.target = a.target AND j.tv = b.value LEFT JOIN counts c ON c.feature = a.target AND c.value = b.value)
"""
MI = """, mi AS (SELECT c.fi, c.fj, greatest(0.0, sum(c.n / na.n_all * ln(c.n / na.n_all / (a.p * b.p)))) AS mi FROM cooc c CROSS JOIN (SELECT count(DISTINCT entity) AS n_all FROM cells) na
    JOIN p a ON a.feature = c.fi AND a.value = c.vi JOIN counts ca ON ca.feature = c.fi AND ca.value = c.vi AND ca.n >= 5 JOIN p b ON b.feature = c.fj AND b.value = c.vj WHERE c.fi < c.fj GROUP BY c.fi, c.fj),
h AS (SELECT feature, sum(-p * ln(p)) AS h FROM p GROUP BY feature), nmi AS (SELECT fi, fj, CASE WHEN a.h + b.h <= 1e-10 THEN 0 ELSE mi / (a.h + b.h) END AS nmi FROM mi JOIN h a ON a.feature = fi JOIN h b ON b.feature = fj)
"""


def sources(i):
    zones = i.meta.select("entity", "genus", "family", F.expr("CAST(CAST(bround(latitude / 10) * 10 AS INT) AS STRING)").alias("lat"))
    return coding.metadata_as_features(i.cells, zones, "genus", "family", "lat")


def mi_and_entropy(i):
    return stats.mutual_information(i.cells, i.book), stats.feature_entropy(i.p)


@query("SELECT * FROM counts")
def c1_marginal_counts(i):
    return i.counts


@query("SELECT feature, value, round(p, 9) AS p FROM p")
def c2_marginals(i):
    return i.p.withColumn("p", F.round("p", 9))


@query("SELECT * FROM cooc")
def c3_cooccurrence(i):
    return stats.cooccurrence(i.cells)


@query("SELECT feature, round(ln((SELECT count(DISTINCT entity) FROM cells) / (1 + count(DISTINCT entity))), 9) AS idf FROM cells GROUP BY feature")
def c4_idf(i):
    return stats.idf(i.cells).withColumn("idf", F.round("idf", 9))


@query(MI + "SELECT fi, fj, round(mi, 9) AS mi FROM mi")
def c5_mutual_information(i):
    return mi_and_entropy(i)[0].withColumn("mi", F.round("mi", 9))


@query(MI + "SELECT fi, fj, round(nmi, 9) AS nmi FROM nmi")
def c6_nmi(i):
    return stats.nmi(*mi_and_entropy(i)).withColumn("nmi", F.round("nmi", 9))


@query(SOURCES + "SELECT source, sv, target, tv, n_joint, n_st, n_v, n_f FROM stc")
def c7_source_target_counts(i):
    return stats.source_target_counts(sources(i), i.cells)


@query(SOURCES + "SELECT source, sv, target, tv, n_st, round(score, 8) AS score FROM conf")
def c8_log_confidence(i):
    return stats.log_confidence(stats.source_target_counts(sources(i), i.cells), i.book).withColumn("score", F.round("score", 8))


@query(""", ok AS (SELECT feature, value FROM counts WHERE n >= 10), b AS (SELECT c.* FROM cooc c JOIN ok x ON x.feature = c.fi AND x.value = c.vi JOIN ok y ON y.feature = c.fj AND y.value = c.vj)
SELECT fi, vi, fj, vj, round(CASE WHEN min(n) OVER w < 5 THEN 1.0 / count(*) OVER w ELSE n / sum(n) OVER w END, 9) AS p FROM b WINDOW w AS (PARTITION BY fi, vi, fj)""")
def c9_conditional_table(i):
    return stats.conditional_table(i.cells, i.book).withColumn("p", F.round("p", 9))
