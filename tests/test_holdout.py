"""The stratified holdout of b3 keeps its order for ids of any size."""

from compare import assert_same, connection

from lacuna.plans import ORACLES, QUERIES


def test_order_of_large_ids(spark, data, tmp_path):
    part = spark.read.parquet(f"{data}/part.parquet")
    part.crossJoin(spark.range(6).withColumnRenamed("id", "_r")).selectExpr("p_partkey + _r * 1000000007 AS p_partkey", *part.columns[1:]).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = connection(data)
    con.sql(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert_same(QUERIES["b3_stratified_holdout"](spark, str(tmp_path)), con, ORACLES["b3_stratified_holdout"])
