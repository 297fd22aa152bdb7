"""Orders of sentences, compared a batch at a time: the same as pair by pair, for odd sentences too."""

import random

import pytest

from lacuna.operators import trees
from lacuna.plans import QUERIES


def drawn(n):
    rng = random.Random(11)
    out = []
    for sent in range(n):
        size = rng.choice([0, 1, 2, 3, 5, 8, 40])
        ids = list(range(1, size + 1)) if sent % 2 else [rng.choice([None, *range(1, size + 3)]) for _ in range(size)]
        tokens = [(i, f"w{i}", rng.choice(["N", "V", None]), rng.choice([None, -1, 0, *range(1, size + 3)]), rng.choice(["obj", "nsubj", None])) for i in ids]
        order = [(i, rng.choice([None, 1, 2]) if sent % 5 == 0 else p) for p, i in enumerate(rng.sample(ids, size) if sent % 3 else ids)]
        out.append(("x" if sent % 7 else None, "all", sent, tokens, order))
    return out


def arcs(tokens, order):
    """(config, right or None) of each."""
    for i, _, upos, head, deprel in tokens:
        for other, _, tag, _, _ in tokens:
            if None not in (i, other, head) and head > 0 and other == head:
                for a, p in order:
                    for b, q in order:
                        if a == i and b == head:
                            yield "_".join(x for x in (deprel, tag, upos) if x is not None), None if p is None or q is None else (p < q) == (i < head)


@pytest.fixture(scope="module")
def rows():
    return drawn(300)


@pytest.fixture(scope="module")
def treebank(spark, rows):
    return spark.createDataFrame(rows, "lang string, split string, sent long, tokens array<struct<id: int, form: string, upos: string, head: int, deprel: string>>, order array<struct<id: int, position: int>>")


@pytest.mark.parametrize("at_once", [50, 1 << 20])
def test_metrics(treebank, rows, monkeypatch, at_once):
    monkeypatch.setattr(trees, "PLACE_PAIRS", at_once)
    expected = {}
    for lang, _, sent, tokens, order in rows:
        pairs = [(p, q) for a, p in order for b, q in order if None not in (a, b) and b > a]
        if lang and len(order) >= 3 and pairs and all(None not in x for x in pairs):
            right = [r for _, r in arcs(tokens, order)]
            tau = sum((q > p) - (q < p) for p, q in pairs) / len(pairs)
            expected[sent] = (round(tau, 9), all(q > p for p, q in pairs), None if not right or None in right else round(sum(right) / len(right), 9), round((tau + 1) / 2, 9))
    got = {r["sent"]: tuple(round(x, 9) if isinstance(x, float) else x for x in (r["tau"], r["exact"], r["arc_accuracy"], r["score"])) for r in trees.order_metrics(treebank).collect()}
    assert got == expected and len(got) > 100


def test_accuracy_by_config(treebank, rows):
    found = {}
    for lang, _, _, tokens, order in rows:
        for config, right in arcs(tokens, order) if lang else ():
            found.setdefault(config, []).append(right)
    expected = {c: (round(sum(filter(None, x)) / len([r for r in x if r is not None]), 9), len(x)) for c, x in found.items() if len(x) >= 5}
    got = {r["config"]: (round(r["accuracy"], 9), r["n"]) for r in trees.order_accuracy_by_config(treebank).collect()}
    assert got == expected and "N" in got


@pytest.mark.parametrize("name", ["d7_order_metrics", "d8_order_accuracy_by_config", "d9_summarise_orders"])
def test_no_functions_of_list_elements(spark, data, name):
    """They are called one element at a time, and for pairs one pair at a time."""
    assert "lambdafunction" not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
