"""The bootstrap of e8 draws exact resamples."""

import random

from lacuna.operators import evaluate


def test_resamples_have_the_size_of_the_table(spark):
    """With 0 or 1 in each row the mean of 97 draws is a count of 97ths; the ends of the interval of 41 replicates are replicates."""
    rng = random.Random(2)
    rows = [(i, float(rng.random() < 0.6), 0.5) for i in range(97)]
    by_entity = spark.createDataFrame(rows, "entity long, acc double, ref double")
    got = evaluate.resampled_ci(by_entity, 41).first()
    assert all(abs(97 * got[c] - round(97 * got[c])) < 1e-6 for c in ("low", "high"))
    sizes = evaluate.bootstrap_draws(by_entity, 41, "entity").groupBy("replicate").count().collect()
    assert len(sizes) == 41 and {r["count"] for r in sizes} == {97}


def test_query_draws_exact_resamples():
    from lacuna.plans import ORACLES

    assert "list_filter" not in ORACLES["e8_bootstrap_ci"] and "JOIN pl USING (p)" in ORACLES["e8_bootstrap_ci"]


def test_empty_table_gives_nulls(spark):
    empty = spark.createDataFrame([], "entity long, acc double, ref double")
    assert evaluate.resampled_ci(empty, 5).first()["mean"] is None
