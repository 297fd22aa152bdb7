"""Counts and prevalences from cells against those from a row per entity and value."""

import random

import pytest

from lacuna.operators import coding, retrieve
from lacuna.plans import QUERIES


@pytest.fixture(scope="module")
def sides(spark):
    """Cells with two values of a feature, features of a few entities, entities of one side, and a value that no shared entity has."""
    rng = random.Random(8)
    a = [(e, f"f{f}", rng.choice("abc")) for e in range(80) for f in range(4) if rng.random() < 0.7] + [(3, "f0", "two"), (3, "f0", "both"), (3, "f9", "x")]
    b = [(e, f"g{g}", rng.choice("pq")) for e in range(20, 110) for g in range(3) if rng.random() < (0.04 if g == 2 else 0.8)] + [(200, "g0", "alone"), (21, "g1", "too")]
    return tuple(spark.createDataFrame(list(dict.fromkeys(rows)), "entity long, feature string, value string").repartition(3).cache() for rows in (a, b))


def shared(a, b):
    return a.join(b.select("entity").distinct(), "entity", "left_semi")


def test_pairs_equal_profiles(sides):
    a, b = sides
    want = retrieve.contingency(coding.observed_profiles(shared(a, b)), coding.observed_profiles(b))
    got = retrieve.contingency_of_cells(a, b)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("fv_b = 'g0=alone' AND n11 + n01 = 0").count() > 0
    assert retrieve.contingency_of_cells(a, b.limit(0)).count() == 0


@pytest.mark.parametrize("least", [1, 7])
def test_prevalences_equal_profiles(spark, sides, least):
    families = spark.createDataFrame([(e, f"m{e % 6}" if e < 100 else f"m{e}") for e in range(105)], "entity long, family string")
    want = retrieve.family_prevalence(coding.observed_profiles(sides[1]), families, least_coded=least)
    got = retrieve.prevalence_of_cells(sides[1], families, least_coded=least)
    rows = lambda df: sorted((r["fv"], r["family"], round(r["share"], 9)) for r in df.collect())
    assert rows(got) == rows(want) and rows(got)


@pytest.mark.parametrize("name", ["r0_contingency", "r5_rank_candidates", "r10_recall_mrr", "r11b_group_prevalence_cosine", "r12_centroid_cosine"])
def test_no_profile_of_every_value(spark, data, monkeypatch, name):
    def made(*_):
        raise AssertionError("a row per entity and value")

    monkeypatch.setattr(coding, "observed_profiles", made)
    assert QUERIES[name](spark, data).count() >= 0
