"""Rows of a Spark query against those of its SQL in DuckDB, whatever their order."""

import glob
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def split(row):
    """The parts of a row that must be equal, and its numbers with a fraction."""
    exact, close = [], []
    for value in row:
        if value is None or value != value:
            exact.append("")
        elif isinstance(value, float) or type(value).__name__ == "Decimal":
            exact.append("#")
            close.append(float(value))
        else:
            exact.append(str(int(value) if isinstance(value, bool) else value))
    return exact, close


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(split([r[i] for i in at]) for r in rows)


def assert_same(df, con, sql):
    found = con.sql(sql)
    columns, expected = rows_of(found.columns, found.fetchall())
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert names == columns and len(got) == len(expected)
    for (e1, c1), (e2, c2) in zip(got, expected, strict=True):
        assert e1 == e2
        assert all(abs(x - y) <= 1e-5 * (1 + abs(y)) for x, y in zip(c1, c2, strict=True)), (e1, c1, c2)
