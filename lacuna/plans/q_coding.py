"""Queries of the coding operators."""

from pyspark.sql import functions as F

from lacuna.operators import coding
from lacuna.plans.registry import query

CATALOG = """, cat AS (SELECT feature, (row_number() OVER (ORDER BY feature, pos) - 1)::INT AS bin_col, pos, pos_value, neg_value, n_vals FROM (
    SELECT feature, 0 AS pos, max(value) AS pos_value, min(value) AS neg_value, max(k) AS n_vals FROM book WHERE k = 2 GROUP BY feature
    UNION ALL SELECT feature, vi, value, NULL, k FROM book WHERE k > 2))
"""


@query(CATALOG + "SELECT entity, feature, bin_col, (value = pos_value)::INT AS bit FROM cells JOIN cat USING (feature)")
def k1_binarise(i):
    return coding.binarise(i.cells, coding.bin_catalog(i.book))


@query(CATALOG + "SELECT * FROM cat")
def k2_bin_catalog(i):
    return coding.bin_catalog(i.book)


@query("SELECT feature, value, vi, k, fi, gid FROM book")
def k3_codebook(i):
    return i.book


@query(", b2 AS (SELECT * FROM book WHERE value <> 's5') SELECT entity, fi, vi FROM cells JOIN b2 USING (feature, value)")
def k4_encode(i):
    return coding.encode(i.cells, i.book.filter("value <> 's5'"))


@query("SELECT entity, gid FROM cells JOIN book USING (feature, value)")
def k5_observed_triples(i):
    return coding.observed_triples(i.cells, i.book)


@query("SELECT entity, feature, value FROM cells UNION ALL SELECT entity, 'genus', genus FROM meta UNION ALL SELECT entity, 'family', family FROM meta")
def k6_metadata_as_features(i):
    return coding.metadata_as_features(i.cells, i.meta, "genus", "family")


@query()
def k7_geo_clusters(i):
    return coding.geo_clusters(i.meta, 8)


@query("SELECT entity, (round_even(latitude / 10, 0) * 10)::INT AS lat_zone, (round_even(longitude / 20, 0) * 20)::INT AS lon_zone FROM meta")
def k8_zones(i):
    from lacuna.functions.columns import nearest_step

    return i.meta.select("entity", nearest_step(F.col("latitude"), 10).alias("lat_zone"), nearest_step(F.col("longitude"), 20).alias("lon_zone"))


@query("""SELECT DISTINCT concat_ws('=', c.feature, b.value) AS fv, c.feature, c.entity, bool_or(c.value = b.value) OVER (PARTITION BY c.feature, b.value, c.entity) AS present
    FROM cells c JOIN (SELECT DISTINCT feature, value FROM cells JOIN (SELECT DISTINCT entity FROM other) USING (entity)) b USING (feature) JOIN (SELECT DISTINCT entity FROM other) USING (entity)""")
def k9_observed_profiles(i):
    return coding.observed_profiles(i.cells, i.other.select("entity").distinct())


@query("""SELECT concat_ws('=', feature, v) AS fv, feature, entity, value = v AS present FROM (SELECT entity, feature, arg_min(value, fno) AS value FROM
    (SELECT entity, 'x' AS feature, value, fno FROM gold0 WHERE value IN ('s0', 's1', 's2', 's3') OR feature = 'price') GROUP BY ALL) CROSS JOIN (SELECT unnest(['s0', 's1', 's2', 's3']) AS v)""")
def k10_enumerated_profiles(i):
    cells = i.all_cells.filter("value IN ('s0', 's1', 's2', 's3') OR feature = 'price'").withColumn("feature", F.lit("x"))
    return coding.enumerated_profiles(cells, ["s0", "s1", "s2", "s3"], "fno")


@query(""", labels AS (SELECT DISTINCT concat(feature, '=', CASE WHEN vi < 2 THEN vi::VARCHAR ELSE value END) AS label FROM book), known AS (SELECT DISTINCT feature AS label FROM cells UNION SELECT concat(feature, '=', value) FROM book)
SELECT label, CASE WHEN label IN (SELECT label FROM known) THEN label WHEN label LIKE '%=1' AND split_part(label, '=', 1) IN (SELECT label FROM known) THEN split_part(label, '=', 1) END AS target FROM labels""")
def k11_feature_id_of(i):
    labels = i.book.select(F.concat("feature", F.lit("="), F.when(F.col("vi") < 2, F.col("vi").cast("string")).otherwise(F.col("value"))).alias("label")).distinct()
    known = i.book.select(F.col("feature").alias("label")).union(i.book.select(coding.value_label("feature", "value"))).distinct()
    return coding.feature_id_of(labels, known)
