"""Counts, classes, transitions and scores against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import brown
from lacuna.llm.queries import QUERIES

COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def class_of(model, word):
    v = model.vocabulary
    if word is None:
        return model.classes[v.end]
    at = v.words.index(word) if word in v.words else v.n_units
    return model.classes[at if at < v.n_units else v.n_units + 1 + brown.ending(word)]


def plain_scores(docs, model):
    """All columns, with counts, interpolation weights and probabilities worked out one by one from the model's classes."""
    taught = [tokens(t) for d, t in docs if not is_held(d)]
    counts = Counter(w for t in taught for w in t)
    n, v = sum(counts.values()), len(counts)
    end = model.classes[model.vocabulary.end]
    known = {w: class_of(model, w) for d, t in docs for w in set(tokens(t))}
    c3, c2, of3, of2, c1, size = (Counter() for _ in range(6))
    for t in taught:
        a = b = end
        for w in t:
            c = known[w]
            for table, key in ((c3, (a, b, c)), (c2, (b, c)), (of3, (a, b)), (of2, b), (c1, c), (size, c)):
                table[key] += 1
            a, b = b, c
    votes = [1, 1, 1]
    less = lambda x, y: (x - 1) / (y - 1) if y > 1 else 0.0
    for (a, b, c), k in c3.items():
        shares = [less(k, of3[a, b]), less(c2[b, c], of2[b]), (c1[c] - 1) / max(1, n - 1)]
        votes[shares.index(max(shares))] += k
    weight = [x / sum(votes) for x in votes]

    def probability(a, b, c):
        parts = [(weight[0], c3[a, b, c], of3[a, b]), (weight[1], c2[b, c], of2[b]), (weight[2], c1[c], n)]
        return sum(w * x / y for w, x, y in parts if y) / sum(w for w, _, y in parts if y)

    unknown = 0.5 / (n + 0.5 * (v + 1))
    rows = []
    for d, text in docs:
        a = b = end
        score = 0.0
        for w in tokens(text):
            c = known[w]
            score += math.log10((1 - unknown) * probability(a, b, c) * counts[w] / size[c]) if counts[w] else math.log10(unknown)
            a, b = b, c
        t = tokens(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        rows.append((d, is_held(d), len(t), sum(counts[w] > 0 for w in t), n, base, score))
    return rows


def assert_scores(df, expected):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)
    expected = sorted(expected, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9, atol=1e-9)


def invented(n, seed=3):
    """Sentences of a grammar with four kinds of words in turn, and rare words at the end."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}{'xyz'[i % 3]}" for i in range(12)] for k in ("Da", "no", "ve", "ad")]
    texts = [" ".join(rng.choice(kinds[j % 4]) for j in range(rng.choice([0, 4, 8, 16]))) + (f" rare{rng.randint(0, 900)}" if rng.random() < 0.3 else "") for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, None), (None, texts[9]), (None, ""), (n, "é " * 9)]


@pytest.mark.parametrize("shares", [(1e-6, 1e-5), (0.004, 0.01), (0.9, 0.9)])
def test_scores_equal_plain_version(spark, scratch, shares):
    docs = invented(300)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = brown.fit(table, scratch, n_classes=6, rounds=4, known_share=shares[0], unit_share=shares[1])
    assert (len(model.vocabulary.words) < 100) == (shares[0] > 1e-6)
    assert_scores(brown.score(table, model), plain_scores(docs, model))


def test_probabilities_sum_to_one(spark, scratch):
    table = spark.createDataFrame(invented(200), "doc_id long, text string")
    model = brown.fit(table, scratch, n_classes=5, rounds=2)
    v = model.vocabulary
    words = [*range(len(v.words)), None]
    classes = [class_of(model, v.words[i] if i is not None else None) for i in words]
    counts = np.array([v.counts[i] if i is not None else v.n_docs for i in words])
    emit = counts * 10 ** model.known_terms()[classes]
    sums = (10 ** model.transitions[:, :, classes] * emit).sum(2) + model.unknown
    assert len(words) == v.n_different and np.allclose(sums, 1)


def test_gains_equal_recounting():
    rng = np.random.default_rng(5)
    n_units, n_classes = 30, 5
    pairs = rng.integers(0, 4, (n_units, n_units)).astype(float)
    pairs = pairs + pairs.T  # as many before as after, as in texts
    classes = rng.integers(0, n_classes, n_units)

    def counted(classes):
        one = np.eye(n_classes)[classes]
        return one.T @ pairs @ one

    for unit in range(n_units):
        others = np.arange(n_units) != unit
        before, after = (np.bincount(classes[others], n[others], n_classes) for n in (pairs[:, unit], pairs[unit]))
        gain = brown.gains(counted(classes), classes[unit], before, after, pairs[unit, unit])
        moved = []
        for to in range(n_classes):
            changed = classes.copy()
            changed[unit] = to
            moved.append(brown.likelihood(counted(changed)))
        assert np.allclose(gain - gain[classes[unit]], np.array(moved) - moved[classes[unit]])


def test_exchange_finds_the_kinds(spark, scratch):
    """Words of one kind share classes that words of other kinds are not in, and the likelihood is that of the counts of all texts."""
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(invented(600))], "doc_id long, text string").filter("text NOT LIKE '%rare%' AND text NOT LIKE 'é%'")
    model = brown.fit(docs, scratch, learn=None, n_classes=4, rounds=10)
    kinds = {}
    for word, c in zip(model.vocabulary.words, model.classes, strict=False):
        kinds.setdefault(word[:2], Counter())[int(c)] += 1
    assert sorted(c.most_common(1)[0][0] for c in kinds.values()) == [0, 1, 2, 3]
    assert all(c.most_common(1)[0][1] == 12 for c in kinds.values())


def test_query(spark, data):
    got = [r.asDict() for r in QUERIES["op11_lm_score"](spark, data).collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert set(docs) == {r["doc_id"] for r in got} and len(got) == len(docs)
    counts = Counter(w for d, t in docs.items() if not is_held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in got:
        t = tokens(docs[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) < 1e-6
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_tables(spark, scratch, odd, empty, rows):
    docs = {"odd": odd, "empty": empty}[rows]
    model = brown.fit(docs, scratch, n_classes=3, rounds=2)
    assert_scores(brown.score(docs, model), plain_scores([(r["doc_id"], r["text"]) for r in docs.collect()], model))


def test_nothing_to_learn_from(spark, scratch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = brown.fit(docs, scratch, learn=F.lit(False), n_classes=3, rounds=1)
    rows = brown.score(docs, model, learn=F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
