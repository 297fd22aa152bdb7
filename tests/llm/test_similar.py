"""Groups of similar five-word shingle sets against comparing all pairs."""

import random

import corpus_pipeline

from lacuna.llm import similar


def plain_sets(texts, words=5):
    tokens = [(t or "").lower().split() for t in texts]
    return [frozenset(tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))) if t else frozenset() for t in tokens]


def plain_groups(docs):
    """Smallest id that each document reaches over links of similarity 0.8, by comparing all pairs; and the number of links."""
    sets, root, n = plain_sets([t for _, t in docs]), {d: d for d, _ in docs}, 0

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs[:i]):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                n += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d, _ in docs}, n


def near_copies(seed=9):
    rng = random.Random(seed)
    words, texts = [f"w{i}" for i in range(500)], ["", None, "a b", "A b", "one two three four five"]
    for _ in range(15):
        base = [rng.choice(words) for _ in range(rng.choice([40, 150, 600]))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_groups_equal_all_pairs(spark, scratch, monkeypatch):
    docs = near_copies()
    expected, n = plain_groups(docs)
    assert n > 100
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(frame, scratch).collect()} == expected
    monkeypatch.setattr(similar, "BLOCK", 600)
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(frame, scratch).collect()} == expected


def test_stage_drops_copies_of_similarity_080(spark, data):
    docs = near_copies(10)
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), data)
    assert {r["doc_id"] for r in kept.collect()} == set(plain_groups(docs)[0].values())


def test_stage_on_given_table(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    kept = corpus_pipeline.near_duplicate_stage(spark, frame, data)
    assert {r["doc_id"] for r in kept.collect()} == set(plain_groups(docs)[0].values())


def test_odd_tables(odd, empty, scratch):
    assert similar.near_duplicates(empty, scratch).count() == 0
    kept = similar.keep_one(odd, scratch)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8]
