"""Cells are dealt by entity to as many tasks as the table has rows for; no feature's rows meet in one task."""

import re

import pytest
from pyspark.sql import functions as F

from lacuna.operators import coding
from lacuna.plans import QUERIES, inputs

QUERY_NAMES = ("e12_count_eval_items", "e24_calibrate_temperature", "i19_confident_pseudo_labels", "r0_contingency", "r11b_group_prevalence_cosine", "r12_centroid_cosine")


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_no_feature_is_one_task(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[feature#\d+\]", plan)


@pytest.mark.parametrize("rows", [10, 1000])
def test_tasks_follow_the_rows(spark, data, monkeypatch, rows):
    monkeypatch.setattr(inputs, "PART_ROWS", rows)
    cells = inputs.Inputs(spark, data).cells
    n = spark.read.parquet(f"{data}/part.parquet").count()
    assert cells.rdd.getNumPartitions() == -(-n // rows)


def test_profiles_with_nulls_and_two_values(spark):
    cells = spark.createDataFrame([(1, "f", "a"), (1, "f", "b"), (2, "f", None), (3, "f", "b"), (3, "f", None), (4, "g", "x")], "entity long, feature string, value string")
    got = {(r["fv"], r["entity"]): r["present"] for r in coding.observed_profiles(cells.filter(F.col("value").isNotNull())).collect()}
    assert got == {("f=a", 1): True, ("f=b", 1): True, ("f=a", 3): False, ("f=b", 3): True, ("g=x", 4): True}
    got = {(r["fv"], r["entity"]): r["present"] for r in coding.observed_profiles(cells).filter("feature = 'f'").collect()}
    assert got[("f=a", 2)] is None and got[("f=a", 3)] is False and got[("f", 1)] is None
