"""The keyed permutation: a bijection for any size, the same in SQL, and even."""

from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lacuna.functions.columns import permuted
from lacuna.plans.inputs import permuted_sql


def moved(spark, n, replicates):
    rows = spark.range(n).select(F.col("id").alias("p"), F.lit(n).alias("n")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    out = np.full((replicates, n), -1)
    for row in rows.withColumn("moved", permuted("p", "n", 7, "r")).collect():
        out[row["r"], row["p"]] = row["moved"]
    return out


def test_is_a_bijection_and_equals_sql(spark):
    for n in (1, 2, 3, 10, 97):
        got = moved(spark, n, 12)
        assert all(sorted(line) == list(range(n)) for line in got.tolist())
        sql = duckdb.sql(f"SELECT r, p, {permuted_sql('p', 'n', 7, 'r')} AS m FROM (SELECT unnest(range(0, {n})) AS p, {n} AS n) CROSS JOIN (SELECT unnest(range(0, 12)) AS r)").fetchall()
        assert all(got[r, p] == m for r, p, m in sql)


def test_is_even(spark):
    """Over many keys each place goes everywhere about equally often, pairs of places too, and keys are unlike each other."""
    n, replicates = 7, 4200
    got = moved(spark, n, replicates)
    for p in range(n):
        counts = Counter(got[:, p].tolist())
        assert sum((counts[v] - replicates / n) ** 2 / (replicates / n) for v in range(n)) < 25  # chi square of 6 degrees: above 22.5 in one of 1000
    pairs = Counter(zip(got[:, 2].tolist(), got[:, 5].tolist(), strict=True))
    expected = replicates / (n * (n - 1))
    assert len(pairs) == n * (n - 1) and sum((c - expected) ** 2 / expected for c in pairs.values()) < 80  # 41 degrees
    assert abs(np.corrcoef(got[:-1].ravel(), got[1:].ravel())[0, 1]) < 0.02
    large = moved(spark, 1000, 20)
    assert np.abs(np.corrcoef(large)[np.triu_indices(20, 1)]).max() < 0.15
    assert abs(np.corrcoef(large.ravel(), np.tile(np.arange(1000), 20))[0, 1]) < 0.03
