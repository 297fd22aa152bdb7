"""Queries on vectors."""

from pyspark.sql import functions as F

from lacuna.functions.columns import normalised
from lacuna.operators import retrieve, vectors
from lacuna.plans.inputs import draw_sql, permuted_sql
from lacuna.plans.q_retrieve import SOFT, soft, values_of
from lacuna.plans.registry import query

V = ", v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
COS = "list_cosine_similarity({a}, {b})"
NEAR = V + ", nn AS (SELECT a.id AS source, b.id AS target, round(list_cosine_similarity(a.vec, b.vec), 10) AS cos, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.id)::INT AS rank FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0)"


def asked(i):
    """The stated set of queries of a search."""
    return i.vecs.filter("id % 50 = 0")


def r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(V + "SELECT id, round(vec[1] / sqrt(list_inner_product(vec, vec)), 6) AS first FROM v")
def v1_l2_normalise(i):
    return i.vecs.select("id", normalised("vec").alias("u")).select("id", F.round(F.element_at("u", 1), 6).alias("first"))


@query(V + "SELECT a.id AS source, b.id AS target, round(greatest(0, least(2, 1 - list_cosine_similarity(a.vec, b.vec))), 6) AS d FROM v a JOIN v b ON a.id < b.id")
def v2_pairwise_cosine(i):
    return vectors.pairwise_distance(i.vecs, digits=6)


@query(V + "SELECT a.id AS source, b.id AS target, round(list_distance(a.vec, b.vec), 6) AS d FROM v a JOIN v b ON a.id < b.id")
def v2b_pairwise_euclidean(i):
    return vectors.pairwise_distance(i.vecs, "euclidean", digits=6)


@query(V + "SELECT a.id AS source, b.id AS target, round(list_sum(list_transform(range(1, 65), lambda k: ((a.vec[k] > 0) <> (b.vec[k] > 0))::INT)) / 64, 6) AS d FROM v a JOIN v b ON a.id < b.id")
def v2c_pairwise_hamming(i):
    signs = i.vecs.withColumn("vec", F.transform("vec", lambda x: (x > 0).cast("int")))
    return vectors.pairwise_distance(signs, "hamming", digits=6)


@query(V + "SELECT a.label AS space, a.id AS source, b.id AS target, round(list_distance(list_concat(a.vec, a.vec), list_concat(b.vec, b.vec)), 6) AS d FROM v a JOIN v b ON a.id < b.id AND a.label = b.label")
def v3_distances_all(i):
    joined = vectors.join_spaces(i.vecs, i.vecs).join(i.vecs.select("id", F.col("label").alias("space")), "id")
    return vectors.pairwise_distance(joined, "euclidean", "space", digits=6)


@query("SELECT vec_id AS id, " + ", ".join(f"round(2 * ({draw_sql(42 + k, 'vec_id')} / 1152921504606846976::DOUBLE) - 1, 9) AS x{k}" for k in range(8)) + " FROM embeddings")
def v3b_random_space(i):
    space = vectors.random_space(i.vecs, 8)
    return space.select("id", *(F.round(F.element_at("vec", k + 1), 9).alias(f"x{k}") for k in range(8)))


@query(NEAR + "SELECT source, target, round(cos, 6) AS cos, rank FROM nn WHERE rank <= 5")
def v4_nearest_neighbours(i):
    return r(vectors.nearest_neighbours(i.vecs, asked(i), 5), "cos")


@query()
def v4b_candidate_pairs(i):
    return vectors.candidate_pairs(i.vecs, 0.3)


@query(V + "SELECT source, target, round(cos, 6) AS cos, rank FROM (SELECT a.id AS source, b.id AS target, list_cosine_similarity(a.vec, b.vec) AS cos, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.id)::INT AS rank FROM v a JOIN v b ON a.id <> b.id AND a.label <> b.label WHERE a.id % 50 = 0) WHERE rank <= 5")
def v5_cross_group_neighbours(i):
    return r(vectors.nearest_neighbours(i.vecs, asked(i), 5, "label"), "cos")


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS first, round(avg(embedding[64]::DOUBLE), 6) AS last FROM embeddings GROUP BY label")
def v6_centroid(i):
    return r(vectors.centroid(i.vecs, "label").select("label", F.element_at("vec", 1).alias("first"), F.element_at("vec", -1).alias("last")), "first", "last")


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER (PARTITION BY label), 6) AS first FROM embeddings")
def v6b_center(i):
    return vectors.center(i.vecs, "label").select("id", F.round(F.element_at("vec", 1), 6).alias("first"))


@query(V + """, d AS (SELECT a.id, a.label, b.label AS other, avg(1 - list_cosine_similarity(a.vec, b.vec)) AS d FROM v a JOIN v b ON a.id <> b.id WHERE a.label IN (SELECT label FROM v GROUP BY label HAVING count(*) > 1) AND b.label IN (SELECT label FROM v GROUP BY label HAVING count(*) > 1) GROUP BY ALL),
s AS (SELECT id, label, max(d) FILTER (label = other) AS i, min(d) FILTER (label <> other) AS o FROM d GROUP BY id, label) SELECT id, label, round((o - i) / greatest(o, i), 5) AS s FROM s""")
def v7_silhouette(i):
    return r(vectors.silhouette(i.vecs, "label"), "s", digits=5)


@query(NEAR + """, k AS (SELECT 1 AS seed, source, list_sort(list(target)) AS t FROM nn WHERE rank <= 5 GROUP BY source UNION ALL SELECT 2, source, list_sort(list(target)) FROM nn WHERE rank BETWEEN 2 AND 6 GROUP BY source UNION ALL SELECT 3, source, list_sort(list(target)) FROM nn WHERE rank BETWEEN 4 AND 8 GROUP BY source)
SELECT a.seed AS a, b.seed AS b, round(avg(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))), 6) AS mean, count(*) AS n FROM k a JOIN k b ON a.source = b.source AND a.seed < b.seed GROUP BY ALL""")
def v8_neighbour_jaccard(i):
    near = vectors.nearest_neighbours(i.vecs, asked(i), 8)
    seeds = F.array_compact(F.array(*(F.when(F.col("rank").between(lo, hi), F.lit(s)) for s, lo, hi in ((1, 1, 5), (2, 2, 6), (3, 4, 8)))))
    return r(vectors.neighbour_jaccard(near.withColumn("seed", F.explode(seeds))), "mean")


SHUFFLED = f""", known AS (SELECT id, label AS grp FROM v WHERE label IN (SELECT label FROM v GROUP BY label HAVING count(*) > 1)), reps AS (SELECT unnest(range(1, 101)) AS rep), here AS (SELECT id, grp, row_number() OVER (ORDER BY {draw_sql(42, "id")}, id) - 1 AS p, count(*) OVER () AS n FROM known),
there AS (SELECT rep, id, {permuted_sql("p", "n", 42, "rep")} AS p FROM here CROSS JOIN reps), lab AS (SELECT 0 AS rep, id, grp FROM known UNION ALL SELECT rep, there.id, here.grp FROM there JOIN here USING (p))"""


@query(NEAR + SHUFFLED + """, sh AS (SELECT a.rep, round(avg((a.grp = b.grp)::INT), 12) AS share FROM nn JOIN lab a ON a.id = nn.source JOIN lab b ON b.id = nn.target AND b.rep = a.rep WHERE nn.rank <= 10 GROUP BY a.rep), tr AS (SELECT share AS truth FROM sh WHERE rep = 0)
SELECT round(any_value(truth), 8) AS share, round(avg(share), 8) AS null_mean, round((count(*) FILTER (share >= truth) + 1) / (count(*) + 1), 8) AS p FROM sh CROSS JOIN tr WHERE rep > 0""")
def v9_group_preservation(i):
    near = vectors.nearest_neighbours(i.vecs, asked(i), 10)
    return r(vectors.group_preservation(near, i.vecs.select("id", F.col("label").alias("group")), 100), "share", "null_mean", "p", digits=8)


def halves(i):
    """Two spaces, the first and the last 32 numbers of each vector, and the first one again at twice the size."""
    a = i.vecs.select("id", F.slice("vec", 1, 32).alias("vec"))
    return a, a.select("id", F.transform("vec", lambda x: x * 2).alias("vec")), i.vecs.select("id", F.slice("vec", 33, 32).alias("vec"))


@query("SELECT 0.0::DOUBLE AS disparity, count(*) AS n FROM embeddings")
def v10_procrustes_disparity(i):
    a, b, _ = halves(i)
    return r(vectors.procrustes_disparity(a, b), "disparity")


@query(V + f""", here AS (SELECT vec[1] AS a1, vec[2] AS a2, vec[33] AS b1, vec[34] AS b2, row_number() OVER (ORDER BY {draw_sql(42, "id")}, id) - 1 AS p, count(*) OVER () AS n FROM v),
there AS (SELECT rep, a1, a2, CASE WHEN rep = 0 THEN p ELSE {permuted_sql("p", "n", 42, "rep")} END AS p FROM here CROSS JOIN (SELECT unnest(range(0, 51)) AS rep)),
s AS (SELECT rep, covar_pop(a1, h.b1) AS m11, covar_pop(a1, h.b2) AS m12, covar_pop(a2, h.b1) AS m21, covar_pop(a2, h.b2) AS m22, (var_pop(a1) + var_pop(a2)) * (var_pop(h.b1) + var_pop(h.b2)) AS t FROM there JOIN here_b h USING (p) GROUP BY rep),
d AS (SELECT rep, 1 - (m11 ** 2 + m12 ** 2 + m21 ** 2 + m22 ** 2 + 2 * abs(m11 * m22 - m12 * m21)) / t AS d FROM s)
SELECT round((SELECT d FROM d WHERE rep = 0), 7) AS disparity, round(avg(d), 7) AS null_mean, round((count(*) FILTER (d <= (SELECT d FROM d WHERE rep = 0)) + 1) / (count(*) + 1), 7) AS p FROM d WHERE rep > 0""".replace("JOIN here_b h", "JOIN (SELECT p, b1, b2 FROM here) h"))
def v11b_procrustes_permutation_plane(i):
    """Planes, whose singular values SQL can give: their sum, squared, is that of all squares and twice the determinant."""
    a, b = (i.vecs.select("id", F.slice("vec", start, 2).alias("vec")) for start in (1, 33))
    return r(vectors.procrustes_permutation(a, b, 50), "disparity", "null_mean", "p", digits=7)


@query()
def v11_procrustes_permutation(i):
    a, _, c = halves(i)
    return vectors.procrustes_permutation(a, c, 20)


@query("SELECT vec_id AS source, vec_id AS target, 1::INT AS rank FROM embeddings")
def v12_rotate_and_match(i):
    a, _, _ = halves(i)
    turned = a.select("id", F.reverse("vec").alias("vec"))
    return vectors.rotate_and_match(a, turned, a, turned, 1).drop("cos")


@query("SELECT unnest(range(1, 11))::INT AS component, 1.0::DOUBLE AS correlation")
def v13_cca(i):
    a, _, _ = halves(i)
    mixed = a.select("id", F.transform("vec", lambda x, p: x * (p + 1) + F.element_at("vec", 1)).alias("vec"))
    return r(vectors.cca(a, mixed), "correlation", digits=4)


@query("""SELECT round(avg(n), 6) AS mean_a, round(stddev_pop(n), 6) AS std_a, round(avg(2 * n), 6) AS mean_b, round(2 * stddev_pop(n), 6) AS std_b, round(list_avg(quantile_cont(n, [(k + 0.5) / 200 for k in range(0, 200)])), 6) AS wasserstein, 0.5::DOUBLE AS ratio FROM (SELECT sqrt(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
def v14_norm_summary(i):
    a, b, _ = halves(i)
    return r(vectors.norm_summary(a, b), "mean_a", "std_a", "mean_b", "std_b", "wasserstein", "ratio")


@query("SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, count(*) AS n FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def v14b_cosine_summary(i):
    pairs = i.vecs.select("id", F.col("vec").alias("_a")).join(i.vecs.select((F.col("id") - 1).alias("id"), F.col("vec").alias("_b")), "id")
    return r(vectors.cosine_summary(pairs), "mean", "std")


def drawn_sql(name: str, table: str) -> str:
    return f"""{name}p AS (SELECT id, vec, row_number() OVER (ORDER BY {draw_sql(42, "id")}, id) - 1 AS p FROM {table}), {name} AS (SELECT list_cosine_similarity(x.vec, y.vec) AS c FROM (SELECT unnest(range(0, 500)) AS no)
    JOIN {name}p x ON x.p = {draw_sql(43, "no")} % (SELECT count(*) FROM {table}) JOIN {name}p y ON y.p = {draw_sql(44, "no")} % (SELECT count(*) FROM {table}) WHERE x.id <> y.id)"""


QUANTILES = "[" + ", ".join(str((k + 0.5) / 100) for k in range(100)) + "]"


@query(f""", va AS (SELECT vec_id AS id, embedding[1:32]::DOUBLE[] AS vec FROM embeddings), vb AS (SELECT vec_id AS id, list_transform(embedding[33:64]::DOUBLE[], lambda x: 3 * x) AS vec FROM embeddings), {drawn_sql("ca", "va")}, {drawn_sql("cb", "vb")},
d AS (SELECT avg(abs(x)) AS distance FROM (SELECT unnest((SELECT quantile_cont(c, {QUANTILES}) FROM ca)) - unnest((SELECT quantile_cont(c, {QUANTILES}) FROM cb)) AS x)),
m AS (SELECT (SELECT avg(sqrt(list_inner_product(vec, vec))) FROM vb) / (SELECT avg(sqrt(list_inner_product(vec, vec))) FROM va) AS ratio, (SELECT avg(c) FROM ca) AS cos_a, (SELECT avg(c) FROM cb) AS cos_b, distance FROM d)
SELECT round(ratio, 6) AS ratio, round(cos_a, 6) AS cos_a, round(cos_b, 6) AS cos_b, round(distance, 6) AS distance, ratio BETWEEN 0.5 AND 2 AND distance < 0.2 AS sound FROM m""")
def v14c_alignment_rule(i):
    a, _, b = halves(i)
    b = b.select("id", F.transform("vec", lambda x: x.cast("double") * 3).alias("vec"))
    return r(vectors.alignment_rule(a, b, 500), "ratio", "cos_a", "cos_b", "distance")


#: Each four vectors in a row.
QUADS = V + ", q AS (SELECT id AS a, id + 1 AS b, id + 2 AS c, id + 3 AS d FROM v WHERE id % 4 = 0)"


def quads(i):
    return i.vecs.filter("id % 4 = 0").selectExpr("id AS a", "id + 1 AS b", "id + 2 AS c", "id + 3 AS d")


@query(QUADS + "SELECT a, b, c, d, round(sqrt(list_sum(list_transform(range(1, 65), lambda k: ((va.vec[k] - vb.vec[k]) - (vc.vec[k] - vd.vec[k])) ** 2))), 5) AS residual FROM q JOIN v va ON va.id = a JOIN v vb ON vb.id = b JOIN v vc ON vc.id = c JOIN v vd ON vd.id = d")
def v15_analogy_residual(i):
    return r(vectors.analogy_residual(quads(i), i.vecs), "residual", digits=5)


RESIDUAL = "sqrt(list_sum(list_transform(range(1, 65), lambda k: ((va.vec[k] - vb.vec[k]) - (vc.vec[k] - vd.vec[k])) ** 2)))"
OF = " JOIN v va ON va.id = {0} JOIN v vb ON vb.id = {1} JOIN v vc ON vc.id = {2} JOIN v vd ON vd.id = {3}"


@query(QUADS + f""", pl AS (SELECT id, row_number() OVER (ORDER BY {draw_sql(42, "id")}, id) - 1 AS p FROM v), dr AS (SELECT no, {", ".join(f"{draw_sql(42 + k, 'no')} % (SELECT count(*) FROM v) AS p{k}" for k in range(4))} FROM (SELECT unnest(range(0, 200)) AS no)),
nu AS (SELECT {RESIDUAL} AS x FROM dr JOIN pl l0 ON l0.p = p0 JOIN pl l1 ON l1.p = p1 JOIN pl l2 ON l2.p = p2 JOIN pl l3 ON l3.p = p3{OF.format("l0.id", "l1.id", "l2.id", "l3.id")}), rs AS (SELECT a, b, c, d, {RESIDUAL} AS residual FROM q{OF.format("a", "b", "c", "d")})
SELECT a, b, c, d, round(residual, 5) AS residual, round((SELECT avg(x) FROM nu), 6) AS null_mean, round((SELECT quantile_cont(x, 0.05) FROM nu), 6) AS null_p5, round((SELECT median(x) FROM nu), 6) AS null_median, round((SELECT avg((x <= residual)::INT) FROM nu), 6) AS p FROM rs""")
def v15b_analogy_test(i):
    return r(r(vectors.analogy_test(quads(i), i.vecs, 200), "null_mean", "null_p5", "null_median", "p"), "residual", digits=5)


@query(SOFT + ", w AS (SELECT DISTINCT feature, length(feature)::DOUBLE AS w FROM sp) SELECT entity, round(sum(p * w * vec[1]) / (SELECT sum(w) FROM w), 6) AS first FROM sp JOIN vv USING (feature, value) JOIN w USING (feature) GROUP BY entity")
def v16_expected_value_vector(i):
    weights = i.book.select("feature", F.length("feature").cast("double").alias("w")).distinct()
    return vectors.expected_value_vector(soft(i), values_of(i), weights).select("entity", F.round(F.element_at("vec", 1), 6).alias("first"))


@query(SOFT + "SELECT entity, count(*) AS n FROM (SELECT DISTINCT entity, unnest(range(0, 3)) AS k FROM sp) GROUP BY entity")
def v16b_random_mask(i):
    return vectors.random_mask(soft(i), 0.5).select("entity", "feature").distinct().groupBy("entity").agg(F.count("*").alias("n"))


@query(SOFT + "SELECT entity, gid FROM (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY round(p, 12) DESC, value) AS r FROM sp) JOIN book USING (feature, value) WHERE r = 1")
def v17_onehot_prediction(i):
    return vectors.onehot_prediction(soft(i).withColumn("p", F.round("p", 12)), i.book)


@query(V + ", t AS (SELECT id AS a, id + 1 AS n, id + 7 AS f FROM v) SELECT round(avg((list_cosine_similarity(x.vec, y.vec) > list_cosine_similarity(x.vec, z.vec))::INT), 8) AS accuracy, count(z.id) AS n, count(*) - count(z.id) AS skipped FROM t JOIN v x ON x.id = a LEFT JOIN v y ON y.id = n LEFT JOIN v z ON z.id = f")
def v18_triplet_accuracy(i):
    triplets = i.vecs.selectExpr("id AS anchor", "id + 1 AS near", "id + 7 AS far")
    return r(vectors.triplet_accuracy(triplets, i.vecs), "accuracy", digits=8)


def ordinal_items(i):
    return i.vecs.select("label", "id", "vec", (F.col("id") * 7 % 11).alias("place"))


@query(V + """, pr AS (SELECT a.label, abs(a.id * 7 % 11 - b.id * 7 % 11) AS g, round(1 - list_cosine_similarity(a.vec, b.vec), 12) AS d FROM v a JOIN v b ON a.label = b.label AND a.id < b.id),
r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY g) + (count(*) OVER (PARTITION BY label, g) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY label ORDER BY d) + (count(*) OVER (PARTITION BY label, d) - 1) / 2.0 AS ry FROM pr)
SELECT label, round(CASE WHEN count(*) >= 3 THEN covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) END, 6) AS rho, count(*) AS n FROM r GROUP BY label""")
def v19_ordinal_spearman(i):
    return r(vectors.ordinal_spearman(ordinal_items(i), "label"), "rho")


WEIGHTS = ", x AS (SELECT feature, sum(n * length(value)) % 7 - 3.0::DOUBLE AS x FROM counts GROUP BY feature)"


@query(WEIGHTS + """SELECT 'positive' AS strategy, feature, greatest(0, x) AS w FROM x UNION ALL SELECT 'rank', feature, row_number() OVER (ORDER BY x, feature DESC) / count(*) OVER () FROM x
    UNION ALL SELECT 'threshold', feature, (x > avg(x) OVER () + stddev_pop(x) OVER ())::INT::DOUBLE FROM x UNION ALL SELECT 'top_k', feature, (row_number() OVER (ORDER BY x DESC, feature) <= 2)::INT::DOUBLE FROM x
    UNION ALL SELECT 'domain', feature, greatest(0.1, avg(x) OVER (PARTITION BY feature < 'o')) FROM x""")
def v20_feature_weights(i):
    x = i.counts.groupBy("feature").agg((F.sum(F.col("n") * F.length("value")) % 7 - 3.0).alias("x"))
    domains = x.select("feature", (F.col("feature") < "o").alias("domain"))
    parts = [vectors.feature_weights(x, s, 2, domains=domains).select(F.lit(s).alias("strategy"), "feature", "w") for s in ("positive", "rank", "threshold", "top_k", "domain")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(V + """, it AS (SELECT id % 3 AS axis, id, vec, label % 4 AS cls FROM v), e AS (SELECT axis, id, cls, k, vec[k] AS x FROM it CROSS JOIN range(1, 65) r(k)), s AS (SELECT axis, cls AS c, k, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL),
sc AS (SELECT e.axis, e.id, e.cls, s.c, round(sum((s.s - CASE WHEN e.cls = s.c THEN e.x ELSE 0 END) * e.x) / sqrt(sum((s.s - CASE WHEN e.cls = s.c THEN e.x ELSE 0 END) ** 2) * sum(e.x ** 2)), 12) AS cos FROM e JOIN s USING (axis, k) WHERE e.cls <> s.c OR s.n > 1 GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY axis, id ORDER BY cos DESC, c) AS r FROM sc) WHERE r = 1)
SELECT axis, round(avg((c = cls)::INT), 8) AS accuracy, count(*) AS n, (SELECT round(max(m) / sum(m), 8) FROM (SELECT count(*) AS m FROM it WHERE it.axis = b.axis GROUP BY cls)) AS chance FROM b GROUP BY axis""")
def v21_axis_centroid_accuracy(i):
    items = i.vecs.select((F.col("id") % 3).alias("axis"), "id", "vec", (F.col("label") % 4).alias("cls"))
    return r(vectors.axis_centroid_accuracy(items, "axis", "cls"), "accuracy", "chance", digits=8)


ORDINAL = """r AS (SELECT {k}, rank() OVER (PARTITION BY {k} ORDER BY g) + (count(*) OVER (PARTITION BY {k}, g) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {k} ORDER BY d) + (count(*) OVER (PARTITION BY {k}, d) - 1) / 2.0 AS ry FROM pr),
rho AS (SELECT {k}, CASE WHEN count(*) >= 3 THEN covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) END AS rho FROM r GROUP BY {k})"""


@query(V + f""", here AS (SELECT id, label, vec, id * 7 % 11 AS place, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(42, "label", "id")}, id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM v),
there AS (SELECT rep, label, id, vec, {permuted_sql("p", "n", 42, "rep")} AS p FROM here CROSS JOIN (SELECT unnest(range(0, 20)) AS rep)), it AS (SELECT rep, t.label, t.id, t.vec, h.place FROM there t JOIN here h ON h.label = t.label AND h.p = t.p), pr AS (SELECT a.rep, a.label, abs(a.place - b.place) AS g, round(1 - list_cosine_similarity(a.vec, b.vec), 12) AS d FROM it a JOIN it b ON a.rep = b.rep AND a.label = b.label AND a.id < b.id),
{ORDINAL.format(k="rep, label")} SELECT label, round(avg(rho), 6) AS mean, round(stddev_pop(rho), 6) AS std FROM rho GROUP BY label""")
def v22_shuffled_null(i):
    return r(vectors.shuffled_ordinal_null(ordinal_items(i), 20, "label"), "mean", "std")


@query(V + f""", pr AS (SELECT a.label, abs(a.id * 7 % 11 - b.id * 7 % 11) AS g, round(1 - list_cosine_similarity(a.vec, b.vec), 12) AS d FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE a.label % 2 = 0), {ORDINAL.format(k="label")},
it AS (SELECT label, id, vec, id % 3 AS cls FROM v WHERE label % 2 = 1), e AS (SELECT label, id, cls, k, vec[k] AS x FROM it CROSS JOIN range(1, 65) r(k)), s AS (SELECT label, cls AS c, k, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL),
sc AS (SELECT e.label, e.id, e.cls, s.c, round(sum((s.s - CASE WHEN e.cls = s.c THEN e.x ELSE 0 END) * e.x) / sqrt(sum((s.s - CASE WHEN e.cls = s.c THEN e.x ELSE 0 END) ** 2) * sum(e.x ** 2)), 12) AS cos FROM e JOIN s USING (label, k) WHERE e.cls <> s.c OR s.n > 1 GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY cos DESC, c) AS r FROM sc) WHERE r = 1)
SELECT label, 'ordinal' AS type, round(rho, 6) AS x FROM rho UNION ALL SELECT label, 'permutation', round(avg((c = cls)::INT), 6) FROM b GROUP BY label""")
def v23_diagnose_by_type(i):
    """Each group of items goes to the diagnostic of its annotated type; one union plan keyed by group."""
    kind = F.col("label") % 2
    ordinal = vectors.ordinal_spearman(ordinal_items(i).filter(kind == 0), "label").select("label", F.lit("ordinal").alias("type"), F.col("rho").alias("x"))
    items = i.vecs.filter(kind == 1).select("label", "id", "vec", (F.col("id") % 3).alias("cls"))
    axis = vectors.axis_centroid_accuracy(items, "label", "cls").select("label", F.lit("permutation").alias("type"), F.col("accuracy").alias("x"))
    return r(ordinal.unionByName(axis), "x")
