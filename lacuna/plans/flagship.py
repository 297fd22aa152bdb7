"""How well does the group's majority fill hidden cells, by group? Preparation, coding, a leakage-safe split, two imputers and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.scratch import written
from lacuna.operators import coding, impute, prep, splits
from lacuna.plans.inputs import Inputs
from lacuna.plans.q_splits import ORDER
from lacuna.plans.registry import ORACLES, PRELUDE, QUERIES

SQL = PRELUDE + f""", rich AS (SELECT * FROM cells WHERE entity IN (SELECT entity FROM cells GROUP BY entity HAVING count(*) >= 4)),
good AS (SELECT * FROM rich WHERE (feature, value) IN (SELECT (feature, value) FROM rich GROUP BY feature, value HAVING count(DISTINCT entity) >= 10)),
bk AS (SELECT feature, value FROM (SELECT feature, value, count(*) OVER (PARTITION BY feature) AS k FROM (SELECT DISTINCT feature, value FROM good)) WHERE k >= 2),
coded AS (SELECT good.*, genus AS branch FROM good JOIN bk USING (feature, value) JOIN meta USING (entity)),
x AS (SELECT *, count(*) OVER (PARTITION BY branch, entity) AS n, row_number() OVER (PARTITION BY branch, entity ORDER BY {ORDER}, feature) AS r FROM coded WHERE branch IN (SELECT branch FROM coded GROUP BY branch HAVING count(DISTINCT entity) >= 5)),
parts AS (SELECT *, CASE WHEN r <= ceil(round(n * 0.5, 9)) THEN 'eval' WHEN r <= ceil(round(n * 0.5, 9)) + least(round_even(n * 0.5, 0), n - ceil(round(n * 0.5, 9))) THEN 'train' ELSE 'unused' END AS part FROM x),
tr AS (SELECT * FROM parts WHERE part = 'train'), ev AS (SELECT * FROM parts WHERE part = 'eval'),
f AS (SELECT feature, value FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM tr GROUP BY feature, value) WHERE r = 1),
g AS (SELECT branch, feature, value FROM (SELECT branch, feature, value, row_number() OVER (PARTITION BY branch, feature ORDER BY count(*) DESC, value) AS r FROM tr GROUP BY branch, feature, value) WHERE r = 1),
acc AS (SELECT ev.branch, ev.entity, avg((coalesce(f.value = ev.value, false))::INT) AS freq, avg((coalesce(coalesce(g.value, f.value) = ev.value, false))::INT) AS genus FROM ev LEFT JOIN f USING (feature) LEFT JOIN g ON g.branch = ev.branch AND g.feature = ev.feature GROUP BY ALL)
SELECT branch, round(avg(freq), 8) AS freq_acc, round(avg(genus), 8) AS group_acc, count(*) AS n_entities FROM acc GROUP BY branch"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(branch, freq_acc, group_acc, n_entities)."""
    i = Inputs(spark, sf_dir)
    cells = prep.null_rare_values(prep.min_features_per_entity(i.cells, 4), 10)
    coded = cells.join(coding.codebook(cells).select("feature", "value"), ["feature", "value"], "left_semi")
    with_branch = coded.join(i.meta.select("entity", F.col("genus").alias("branch")), "entity")
    branches = splits.qualifying_branches(with_branch.select("entity", F.col("branch").alias("genus")))
    # the split trains and tests, so it is computed once
    parts = written(splits.split_by_branch(with_branch, branches, 0.5, F.expr(ORDER), eval_share=0.5), "parts")
    train, test = (parts.filter(F.col("part") == p).select("branch", "entity", "feature", "value") for p in ("train", "eval"))
    # one count serves both imputers: the group's commonest value, and the feature's where the group has none
    counts = train.groupBy("branch", "feature", "value").agg(F.count("*").alias("n"))
    overall = impute.best_value(counts.groupBy("feature", "value").agg(F.sum("n").alias("n")), "feature", score="n").select("feature", F.col("value").alias("freq"))
    grouped = impute.best_value(counts, "branch", "feature", score="n").select("branch", "feature", F.col("value").alias("group"))
    filled = test.join(overall, "feature", "left").join(grouped, ["branch", "feature"], "left").withColumn("group", F.coalesce("group", "freq"))
    right = lambda c: F.avg(F.coalesce(F.col(c) == F.col("value"), F.lit(False)).cast("double")).alias(c)
    by_entity = filled.groupBy("branch", "entity").agg(right("freq"), right("group"))
    share = lambda c: F.round(F.avg(c), 8).alias(f"{c}_acc")
    return by_entity.groupBy("branch").agg(share("freq"), share("group"), F.count("*").alias("n_entities"))


QUERIES["flagship"] = run
ORACLES["flagship"] = SQL
