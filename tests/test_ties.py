"""Rows that an order leaves equal: the first of the table counts, as in SQL."""

import duckdb
from compare import assert_same, connection

from lacuna.plans import ORACLES, QUERIES


def test_first_line_of_a_part(spark, data, tmp_path):
    duckdb.sql(f"COPY (FROM '{data}/part.parquet') TO '{tmp_path}/part.parquet'")
    # every line again with the same number and other suppliers, larger and smaller ones, far from the first; some without supplier or number
    lines = f"FROM '{data}/lineitem.parquet'"
    again = f"SELECT * REPLACE ((l_suppkey * 7 + k * 3) % 10 AS l_suppkey) {lines} CROSS JOIN range(1, 4) r(k)".replace("* REPLACE", "* EXCLUDE (k) REPLACE")
    odd = f"SELECT * REPLACE (CASE WHEN l_partkey % 8 = 1 OR l_partkey % 4 = 3 AND l_orderkey % 2 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, CASE WHEN l_partkey % 4 = 2 THEN NULL ELSE l_suppkey END AS l_suppkey) FROM ({lines} UNION ALL {again})"
    duckdb.sql(f"COPY ({odd}) TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    for other in ("documents", "embeddings"):
        duckdb.sql(f"COPY (FROM '{data}/{other}.parquet') TO '{tmp_path}/{other}.parquet'")
    con = connection(tmp_path)
    con.sql("SET threads = 1")  # several threads meet the rows in any order
    assert_same(QUERIES["p5_attach_meta"](spark, str(tmp_path)), con, ORACLES["p5_attach_meta"])
