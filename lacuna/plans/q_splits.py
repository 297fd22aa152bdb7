"""Queries of the splits. Their orders are key arithmetic, so that SQL can repeat them."""

from pyspark.sql import functions as F

from lacuna.operators import splits
from lacuna.plans.inputs import draw_sql
from lacuna.plans.registry import query

#: An order that another engine can repeat.
ORDER = "(entity * 7919 + length(feature) * 104729) % 1009"


@query("SELECT genus AS branch, count(DISTINCT entity) AS n FROM meta GROUP BY genus HAVING count(DISTINCT entity) >= 5")
def b2_qualifying_branches(i):
    return splits.qualifying_branches(i.meta)


@query(f""", x AS (SELECT genus AS branch, entity, feature, value, count(*) OVER (PARTITION BY genus, entity) AS n, row_number() OVER (PARTITION BY genus, entity ORDER BY {ORDER}, feature) AS r
    FROM cells JOIN meta USING (entity) WHERE genus IN (SELECT genus FROM meta GROUP BY genus HAVING count(*) >= 5))
SELECT branch, entity, feature, value, CASE WHEN r <= ceil(round(n * 0.8, 9)) THEN 'eval' WHEN r <= ceil(round(n * 0.8, 9)) + least(round_even(n * 0.1, 0), n - ceil(round(n * 0.8, 9))) THEN 'train' ELSE 'unused' END AS part FROM x""")
def b1_split_by_branch(i):
    cells = i.cells.join(i.meta.select("entity", F.col("genus").alias("branch")), "entity")
    return splits.split_by_branch(cells, splits.qualifying_branches(i.meta), 0.1, F.expr(ORDER))


@query("SELECT entity, genus, CASE WHEN row_number() OVER (PARTITION BY genus ORDER BY entity * 7919 % 1009, entity) <= greatest(1, floor(round(count(*) OVER (PARTITION BY genus) * 0.2, 9))) THEN 'test' ELSE 'train' END AS part FROM meta")
def b3_stratified_holdout(i):
    return splits.stratified_holdout(i.meta.select("entity", "genus"), "genus", F.expr("struct(entity * 7919 % 1009, entity)"))


@query("SELECT f.family AS fold, entity, CASE WHEN m.family = f.family THEN 'test' ELSE 'train' END AS part FROM meta m CROSS JOIN (SELECT family FROM meta GROUP BY family HAVING (SELECT count(*) FROM meta) - count(*) >= 5) f")
def b4_group_holdout(i):
    return splits.group_holdout(i.meta, "family")


@query("SELECT entity, CASE WHEN bool_or((feature = 'size' AND value = 's3') OR (feature = 'adj' AND value = 'red')) THEN 'test' ELSE 'train' END AS part FROM cells GROUP BY entity")
def b5_value_holdout(i):
    return splits.value_holdout(i.cells, i.spark.createDataFrame([("size", "s3"), ("adj", "red")], "feature string, value string"))


@query(f""", x AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, row_number() OVER (PARTITION BY entity ORDER BY {ORDER}, feature) AS r FROM cells)
SELECT entity, feature, value, CASE WHEN r <= floor(n / 2) THEN 'context' ELSE 'target' END AS half FROM x WHERE n >= 4""")
def b6_context_target_halves(i):
    return splits.context_target_halves(i.cells, F.expr(ORDER))


@query(f""", r AS (SELECT unnest(range(1, 6)) AS rep), x AS (SELECT rep, entity, feature, value, row_number() OVER (PARTITION BY rep, entity ORDER BY {draw_sql(43, "rep", "entity", "feature")}, feature) AS r, count(*) OVER (PARTITION BY rep, entity) AS n FROM cells CROSS JOIN r)
SELECT rep::INT AS rep, entity, feature, value, r <= floor(n * (0.3::DOUBLE + {draw_sql(42, "rep", "entity")} / 1152921504606846976::DOUBLE * (0.7::DOUBLE - 0.3::DOUBLE))) AS blanked FROM x""")
def b7_random_blanking(i):
    return splits.random_blanking(i.cells)


@query(f""", x AS (SELECT *, ({ORDER})::DOUBLE AS o FROM cells) SELECT entity, feature, value, CASE WHEN o < (SELECT quantile_cont(o, 0.1) FROM x) THEN 'val' ELSE 'train' END AS part FROM x""")
def b8_random_val_fraction(i):
    return splits.random_val_fraction(i.cells, 0.1, F.expr(ORDER).cast("double"))


@query(f"SELECT entity, genus, ({draw_sql(42, 'genus')} % 5)::INT AS fold FROM meta")
def b9_group_kfold(i):
    return splits.group_kfold(i.meta.select("entity", "genus"), "genus", 5)
