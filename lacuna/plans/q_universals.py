"""Queries of implicational formulas and mined pairs. Formulas are composed from keys of parts and suppliers."""

from pyspark.sql import functions as F

from lacuna.operators import universals
from lacuna.plans.inputs import draw_sql
from lacuna.plans.registry import query

FORM = """CASE s_suppkey % 5 WHEN 0 THEN 'GB' || 3 * s_suppkey || ':1 > GB' || (3 * s_suppkey + 1) || ':0' WHEN 1 THEN 'GB' || 3 * s_suppkey || ':1 & GB' || (3 * s_suppkey + 2) || ':1 > GB3:1' WHEN 2 THEN '(GB1:0 | GB' || 3 * s_suppkey || ':1) > (GB2:1 | GB4:1)'
    WHEN 3 THEN 'sum(GB1:1, GB2:1) > 3' ELSE 'GB' || s_suppkey || ':1 and no arrow' END"""
F_CTE = f", fm AS (SELECT s_suppkey AS id, {FORM} AS formula FROM supplier)"
TOKV = ", tv AS (SELECT concat('GB', vec_id // 2, ':', vec_id % 2) AS token, concat('GB', vec_id // 2) AS feature, embedding::DOUBLE[] AS vec FROM embeddings)"


def formulas(i):
    return universals.parse_formula(i.table("supplier").selectExpr("s_suppkey AS id", f"{FORM} AS formula"))


def token_vectors(i):
    return i.vecs.selectExpr("concat('GB', id DIV 2, ':', id % 2) AS token", "concat('GB', id DIV 2) AS feature", "vec")


PARSED = F_CTE + r"""SELECT id, CASE WHEN id % 5 < 3 THEN array_to_string(regexp_extract_all(split_part(formula, '>', 1), 'GB\d+:\d+'), ' ') ELSE '' END AS ant, CASE WHEN id % 5 < 3 THEN array_to_string(regexp_extract_all(split_part(formula, '>', 2), 'GB\d+:\d+'), ' ') ELSE '' END AS con,
    CASE id % 5 WHEN 0 THEN 'single>single' WHEN 1 THEN 'and>single' WHEN 2 THEN 'or>or' END AS ftype, CASE WHEN id % 5 < 3 THEN 'ok' ELSE 'untestable' END AS status FROM fm"""


@query(PARSED)
def u1_parse_formula(i):
    return formulas(i).select("id", F.array_join("ant", " ").alias("ant"), F.array_join("con", " ").alias("con"), "ftype", "status")


@query("SELECT a.feature, a.value, b.value AS negation FROM book a JOIN book b ON a.feature = b.feature AND a.value <> b.value")
def u2_negation_map(i):
    return universals.negation_map(i.book)


M1 = F_CTE + TOKV + """, m1 AS (SELECT id, list_cosine_similarity(a.vec, b.vec) AS m1 FROM fm JOIN tv a ON a.token = 'GB' || 3 * id || ':1' JOIN tv b ON b.token = 'GB' || (3 * id + 1) || ':0' WHERE id % 5 = 0
    UNION ALL SELECT id, list_cosine_similarity(list_transform(range(1, 65), lambda k: (coalesce(a.vec[k], c.vec[k]) + coalesce(c.vec[k], a.vec[k])) / 2), b.vec) FROM fm LEFT JOIN tv a ON a.token = 'GB' || 3 * id || ':1' LEFT JOIN tv c ON c.token = 'GB' || (3 * id + 2) || ':1' JOIN tv b ON b.token = 'GB3:1' WHERE id % 5 = 1 AND (a.vec IS NOT NULL OR c.vec IS NOT NULL)
    UNION ALL SELECT id, min(m) FROM (SELECT id, a.token, max(list_cosine_similarity(a.vec, b.vec)) AS m FROM fm JOIN tv a ON a.token IN ('GB1:0', 'GB' || 3 * id || ':1') JOIN tv b ON b.token IN ('GB2:1', 'GB4:1') WHERE id % 5 = 2 GROUP BY id, a.token) GROUP BY id)"""


@query(M1 + "SELECT id, round(m1, 6) AS m1 FROM m1")
def u3_implication_cosine(i):
    return universals.implication_cosine(formulas(i), token_vectors(i)).withColumn("m1", F.round("m1", 6))


NULLS = f""", pl AS (SELECT *, row_number() OVER (ORDER BY {draw_sql(42, "token")}, token) - 1 AS p FROM tv), nl AS (SELECT no, list_cosine_similarity(a.vec, b.vec) AS cos FROM (SELECT unnest(range(0, 2000)) AS no)
    JOIN pl a ON a.p = {draw_sql(43, "no")} % (SELECT count(*) FROM tv) JOIN pl b ON b.p = {draw_sql(44, "no")} % (SELECT count(*) FROM tv) WHERE a.feature <> b.feature)"""


@query(TOKV + NULLS + "SELECT no, round(cos, 8) AS cos FROM nl")
def u4_null_cosines(i):
    return universals.null_cosines(token_vectors(i), 2000).withColumn("cos", F.round("cos", 8))


@query(M1 + NULLS + """
SELECT id, round(m1, 6) AS m1, round((m1 - (SELECT avg(cos) FROM nl)) / (SELECT stddev_pop(cos) FROM nl), 5) AS z, round((SELECT avg((round(cos, 9) >= round(m1, 9))::INT) FROM nl), 6) AS p, round(m1 - 0.1, 6) AS margin FROM m1""")
def u5_probe(i):
    null = universals.null_cosines(token_vectors(i), 2000).select(F.round("cos", 9).alias("cos"))
    m1 = universals.implication_cosine(formulas(i), token_vectors(i)).withColumn("m1", F.round("m1", 9))
    out = universals.probe(m1, m1.select("id", F.lit(0.1).alias("anti")), null)
    return out.select("id", F.round("m1", 6).alias("m1"), F.round("z", 5).alias("z"), F.round("p", 6).alias("p"), F.round("margin", 6).alias("margin"))


@query(F_CTE + TOKV + r"SELECT DISTINCT id, t AS token FROM (SELECT id, unnest(regexp_extract_all(formula, 'GB\d+:\d+')) AS t FROM fm WHERE id % 5 < 3) WHERE t NOT IN (SELECT token FROM tv)")
def u5b_missing_tokens(i):
    return universals.missing_tokens(formulas(i), token_vectors(i))


@query(""", x AS (SELECT rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 AS r, s_suppkey % 3 = 0 AS g, s_acctbal AS b FROM supplier)
SELECT sum(r) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2 AS u, round(avg(b) FILTER (g), 6) AS mean1, round(avg(b) FILTER (NOT g), 6) AS mean0, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0 FROM x""")
def u6_mann_whitney(i):
    out = universals.mann_whitney(i.table("supplier").withColumn("all", F.lit(0)), "s_acctbal", "s_suppkey % 3 = 0")
    return out.select("u", F.round("mean1", 6).alias("mean1"), F.round("mean0", 6).alias("mean0"), "n1", "n0")


@query(r"SELECT DISTINCT doc_id AS id, r AS ref FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]+ing)\b', 1)) AS r FROM documents) WHERE r <> 'ing'")
def u7_mine_references(i):
    docs = i.table("documents").select(F.col("doc_id").alias("id"), "text")
    return universals.mine_references(docs, r"([a-z]+ing)\b", docs.select("id", F.lit("ing").alias("ref")))


@query("SELECT o_custkey AS a, o_orderkey % 200 AS b, CASE WHEN o_custkey % 3 = 0 AND u.user_id IS NULL THEN 'both unknown' WHEN o_custkey % 3 = 0 THEN 'a unknown' WHEN u.user_id IS NULL THEN 'b unknown' END AS reason FROM orders LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = o_orderkey % 200")
def u8_verify_pairs(i):
    pairs = i.table("orders").selectExpr("o_custkey AS a", "o_orderkey % 200 AS b")
    known_a = i.table("customer").filter("c_custkey % 3 <> 0").selectExpr("c_custkey AS a")
    known_b = i.table("events").selectExpr("user_id AS b").distinct()
    return universals.verify_pairs(pairs, known_a, known_b)
