"""Queries on treebanks keep a sentence in its row: no token and no pair of tokens is moved or written between steps."""

import pytest

from lacuna.plans import QUERIES


@pytest.mark.parametrize("name", ("d1_arcs", "d7_order_metrics", "d8_order_accuracy_by_config", "d9_summarise_orders"))
def test_no_rows_of_tokens_meet(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "sent#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
