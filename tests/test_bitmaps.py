"""Counts by bitmaps against counts of every entity."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import retrieve


def plain(a, b):
    out = {}
    for (fa, e), x in a.items():
        for (fb, o), y in b.items():
            if e == o:
                out.setdefault((fa, fb), [0, 0, 0, 0])[(0 if y else 1) if x else (2 if y else 3)] += 1
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("chunk", [1, 70, 1000])
def test_equals_counting(spark, chunk):
    rng = random.Random(chunk)
    a = {(f"a{f}", e): rng.random() < 0.4 for f in range(5) for e in range(150) if rng.random() < 0.7}
    b = {(f"b{f}", e): rng.random() < 0.6 for f in range(4) for e in range(30, 190) if rng.random() < (0.02 if f == 3 else 0.7)}
    frames = [spark.createDataFrame([(fv, e, p) for (fv, e), p in side.items()], "fv string, entity long, present boolean").repartition(3) for side in (a, b)]
    got = retrieve.contingency(*frames, chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == plain(a, b)
    assert retrieve.contingency(frames[0], frames[1].limit(0)).count() == 0


def test_values_without_a_common_chunk_are_not_paired(spark):
    """Values of entities in different chunks never meet; a row of the join is a pair of values and a chunk, not an entity."""
    a = spark.range(400).select(F.concat(F.lit("a"), F.col("id") % 2).alias("fv"), F.col("id").alias("entity"), F.lit(True).alias("present"))
    b = a.withColumn("fv", F.concat(F.lit("b"), F.col("entity") % 2))
    numbers = retrieve.numbered_entities(a, b, 100)
    assert numbers.groupBy("chunk").count().agg(F.max("count")).first()[0] < 160 and numbers.count() == 400
    x, y = retrieve.bitmaps(a, numbers), retrieve.bitmaps(b, numbers)
    assert x.count() <= 2 * 4 and x.join(y, "chunk").count() <= 4 * 4
    assert sorted((r["fv_a"], r["fv_b"], r["n11"]) for r in retrieve.contingency(a, b, 100).collect()) == [("a0", "b0", 200), ("a1", "b1", 200)]
