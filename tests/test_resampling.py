"""Poisson resampling against exact resamples, and ranks by ranges against a plain sort."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lacuna.functions.columns import draw, poisson_counts
from lacuna.functions.ranks import ranked
from lacuna.operators import evaluate


def test_poisson_numbers(spark):
    rows = spark.range(300).withColumn("k", draw(1, "id")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(199))))
    drawn = rows.select("id", "r", poisson_counts("k", "r").alias("n")).toPandas()
    counts = Counter(drawn["n"])
    expected = {0: 0.36788, 1: 0.36788, 2: 0.18394, 3: 0.06131, 4: 0.01533}
    assert all(abs(counts[k] / 60_000 - p) < 0.006 for k, p in expected.items())
    table = drawn.pivot(index="id", columns="r", values="n").to_numpy()
    assert abs(table.mean(0).std() * 300**0.5 - 1) < 0.2 and abs(table.mean(1).std() * 200**0.5 - 1) < 0.2  # rows and replicates are independent


def test_interval_agrees_with_exact_resamples(spark):
    rng = random.Random(3)
    rows = [(i, rng.random() ** 2, rng.random()) for i in range(400)]
    by_entity = spark.createDataFrame(rows, "entity long, acc double, ref double")
    got = evaluate.bootstrap_ci(by_entity, 600).first()
    exact = evaluate.bootstrap_draws(by_entity, 600, "entity").groupBy("replicate").agg(F.avg("acc").alias("m"))
    low, high = exact.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
    assert abs(got["low"] - low) < 0.12 * (high - low) and abs(got["high"] - high) < 0.12 * (high - low)
    assert abs(got["mean"] - sum(a for _, a, _ in rows) / 400) < 0.1 * (high - low) and got["p"] < 0.01


def test_only_sums_are_shuffled(spark):
    by_entity = spark.range(1000).selectExpr("id AS entity", "id / 1000 AS acc", "0.5 AS ref")
    plan = evaluate.bootstrap_ci(by_entity, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def plain_ranks(values):
    order = sorted(values, key=lambda v: (v is not None, v))
    first = {}
    for i, v in enumerate(order):
        first.setdefault(v, [i, 0])[1] += 1
    return [first[v][0] + (first[v][1] + 1) / 2 for v in values]


def test_ranks_by_ranges(spark):
    rng = random.Random(5)
    values = [rng.choice([None, 1.5, rng.random(), rng.randint(0, 9) / 2]) for _ in range(700)] + [4.0] * 350
    rows = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "id long, v double, k long").repartition(4)
    got = {r["id"]: r["rank"] for r in ranked(rows, "v").collect()}
    assert [got[i] for i in range(len(values))] == plain_ranks(values)
    by_key = {r["id"]: r["rank"] for r in ranked(rows, "v", "k").collect()}
    for key in range(3):
        ids = [i for i in range(len(values)) if i % 3 == key]
        assert [by_key[i] for i in ids] == plain_ranks([values[i] for i in ids])
    assert ranked(rows.limit(0), "v").count() == 0
    plan = ranked(rows, "v")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("[_part" in line for line in windows)  # one task sees the sizes of ranges only
