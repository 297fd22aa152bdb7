"""Sides of joins are broadcast by their measured sizes, not by those of compressed files."""

import os

import pytest

from lacuna.plans import QUERIES
from lacuna.plans.inputs import SMALL_FILES

QUERY_NAMES = ("c6_nmi", "c7_source_target_counts", "c8_log_confidence", "i5_vector_knn", "i7_rerank_with_prior", "i8_ppmi_expert", "i9_ppmi_plus_vectors", "i10_log_linear_mixture", "i11_log_confidence", "p5_attach_meta")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """A part table whose file is far below 10 MB, though its cells are not."""
    root = tmp_path_factory.mktemp("parts")
    part = spark.read.parquet(f"{data}/part.parquet")
    part.crossJoin(spark.range(2000).withColumnRenamed("id", "_r")).selectExpr("p_partkey + _r * 1000000 AS p_partkey", *part.columns[1:]).coalesce(1).write.parquet(f"{root}/part.parquet")
    spark.read.parquet(*[f"{data}/lineitem.parquet"] * 80).coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    os.symlink(f"{data}/embeddings.parquet", f"{root}/embeddings.parquet")
    return str(root)


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_no_table_of_entities_is_broadcast_by_a_guess(spark, folder, name):
    files = [os.path.join(folder, "part.parquet", f) for f in os.listdir(f"{folder}/part.parquet")]
    assert SMALL_FILES < sum(map(os.path.getsize, files)) < 10 << 20
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [entity" not in plan


def test_measured_sizes_keep_their_limit(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12m")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    for _ in range(2):
        QUERIES["c1_marginal_counts"](spark, data)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(SMALL_FILES)
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "12m"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    QUERIES["c1_marginal_counts"](spark, data)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
