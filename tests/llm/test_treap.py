"""Search against scores of every document, worked out one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, connection

from lacuna.llm import treap
from lacuna.llm.queries import ORACLES, QUERIES


def plain_search(docs, items, k=50):
    """(item_id, rank, doc_id, score) by scoring every document."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda text: re.findall(treap.TERM, (text or "").translate(fold))
    held = [(d, c, sum(c.values())) for d, text in docs if (c := Counter(terms(text)))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted if df[t]}
        scored = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(30))
def test_treap_equals_dense_product(seed):
    rng = np.random.default_rng(seed)
    n_rows, n_columns = rng.integers(1, 200, 2)
    dense = np.where(rng.random((n_rows, n_columns)) < rng.choice([0.02, 0.2, 0.9]), rng.integers(1, 9, (n_rows, n_columns)), 0)
    dense[0, 0] = 3
    row, column = np.nonzero(dense)
    tree = treap.Treap.of(row, column, dense[row, column])
    assert len(tree.masks) + len(row) == len(tree.tops)
    masks, tops = (pa.py_buffer(b) for b in tree.packed())
    tree = treap.Treap.unpacked(tree.height, len(tree.tops), len(row), masks, tops).opened()
    for k in (1, 5, 500):
        rows = np.sort(rng.choice(n_rows, min(n_rows, int(rng.integers(1, 9))), replace=False))
        weights = rng.integers(1, 4, len(rows))
        scores = weights @ dense[rows]
        best = [c for c in np.lexsort((np.arange(n_columns), -scores)) if scores[c] > 0][:k]
        found, score = tree.best(rows, weights, k)
        assert found.tolist() == best and score.tolist() == scores[best].tolist()


def test_ranges_are_left_unsplit(monkeypatch):
    """Of many documents with a common word, only those near the ones with the rare word are looked at."""
    n = 4096
    row, column = np.r_[np.zeros(n, int), np.ones(3, int)], np.r_[np.arange(n), [700, 701, 3000]]
    tree = treap.Treap.of(row, column, np.r_[np.full(n, 5), [900, 900, 900]]).opened()
    split = []
    real = np.argpartition
    monkeypatch.setattr(treap, "AT_ONCE", 4)
    monkeypatch.setattr(treap.np, "argpartition", lambda a, at: split.append(at + 1) or real(a, at))
    assert tree.best(np.array([0, 1]), np.array([1, 50]), 3)[0].tolist() == [700, 701, 3000]
    assert sum(split) < n / 2


@pytest.mark.parametrize("postings", [200, 1_000_000])
def test_many_blocks(spark, scratch, postings):
    rng = random.Random(postings)
    word = lambda: "".join(rng.choice("abcé7A") for _ in range(rng.choice([1, 1, 2, 3])))
    docs = [(i % 170, rng.choice([" ", "-", ".\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(None, "b é a"), (900, None), (901, "b é a"), (902, "b é a")]
    items = [(i % 18, " ".join(word() for _ in range(rng.randint(1, 8)))) for i in range(20)] + [(50, None), (51, "zzz zzz"), (None, "b c")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3 if postings > 200 else 12)
    index = treap.build(table, scratch, postings)
    assert (index.table.filter("height IS NOT NULL").count() > 3) == (postings == 200)
    got = treap.search(index, spark.createDataFrame(items, "item_id int, text string"), scratch, k=20)
    assert rows_of(got) == plain_search(docs, items, 20)


def test_query(spark, data):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = QUERIES["op13_search"](spark, data)
    assert rows_of(got) == plain_search(docs, items)
    assert_same(got, connection(data), ORACLES["op13_search"])


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_tables(spark, scratch, odd, empty, rows):
    docs = {"odd": odd, "empty": empty}[rows]
    items = docs.selectExpr("doc_id AS item_id", "text", "1 AS block", "2 AS term")
    got = treap.search(treap.build(docs, scratch), items, scratch)
    assert rows_of(got) == plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    nothing = treap.search(treap.build(docs, scratch), items.limit(0), scratch)
    assert nothing.columns == got.columns and nothing.count() == 0
