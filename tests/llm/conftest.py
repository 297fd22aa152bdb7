import pytest

from lacuna.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash with those operators add."""
    text = "The quick brown fox jumps over the lazy dog near the old river bank. "
    rows = [
        (1, text * 12, "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, "  \n\t ", "de", "b", 5),
        (None, text * 12 + "tail", "fr", "b", 3),
        (5, "word " * 30_000, "en", "a", 150_000),
        (6, text * 12, "en", "c", 10),
        (6, text * 12, "en", "c", 10),
        (7, "café naïve\n| Home | About | Contact |\nà la carte #1", "fr", "", 7),
        (8, "one two", "en", "b", 7),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("key", "fp", "h", "size", "score", "predicted", "spans", "kept", "component_id", "copies", "target", "ids", "start", "y", "cut", "plan_source", "row")}
    return base.withColumns(clash).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
