"""The splitting CSV reader against Spark's reader of whole files."""

import random

import pytest

from lacuna.sources import files


def whole(spark, path):
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*(c.strip() for c in df.columns))


def written_csv(path, seed, end, n=60):
    """Records with quotes, commas, line ends and empty lines inside fields, empty fields, and lines that look like records."""
    rng = random.Random(seed)
    piece = lambda: rng.choice(["a", "é", ",", '""', "\n", "\n\n", ' "" x', "1,2\n3,4", "b c"])
    field = lambda: rng.choice(["", "plain", "7", '"' + "".join(piece() for _ in range(rng.randint(0, 6))) + '"', '"quoted"'])
    lines = [" ID ,Name,Note "] + [f"{i},{field()},{field()}" for i in range(n)]
    lines.insert(5, "")
    text = "\n".join(lines) + ("\n" if seed % 2 else "")
    path.write_bytes(text.replace("\n", end).encode())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 1 << 20])
def test_equals_the_reader_of_whole_files(spark, tmp_path, end, split):
    for i in range(2):
        written_csv(tmp_path / f"part{i}.csv", i, end)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = str(tmp_path)
        got, expected = files.read_categorical_csv(spark, path), whole(spark, path)
        assert got.columns == expected.columns == ["ID", "Name", "Note"]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in expected.collect()), key=key)
        if split == 64:
            assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10
        ordered = files.read_categorical_csv(spark, str(tmp_path / "part1.csv"), "no").orderBy("no").collect()
        assert [r["ID"] for r in ordered] == [r["ID"] for r in whole(spark, str(tmp_path / "part1.csv")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
