"""Lines of capitals, whatever they begin with."""

import pytest

from lacuna.llm import rules


@pytest.mark.parametrize("start", ["", "A ", '"', "7 ", "- ", " ", "a "])
def test_shouting_needs_no_two_capitals(start):
    assert rules.judge(f"{start}THIS LINE IS WRITTEN IN CAPITALS.") == "shouting"


def test_half_capitals_is_not_shouting():
    assert rules.judge("ABCDEFGHIJ abcdefghij.") == ""
    assert rules.judge("A BCDEFGHIJK abcdefghi.") == "shouting"
    assert rules.judge("A BCDEFGHIJK abcdefgh.") == ""


def test_document_of_such_a_line_is_rejected(spark):
    text = "A " + " ".join(f"{chr(65 + i // 10)}{chr(65 + i % 10)}WORD!" for i in range(60))
    row = rules.apply_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_failed_lines"], row["base_failed"], row["kept"]) == (1, False, False)
