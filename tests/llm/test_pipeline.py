"""Each stage of the pipeline against a plain version of it on its own input."""

import random

import corpus_pipeline
import pytest
from test_duplicates import plain_repeats
from test_models import plain_mix

from lacuna.llm import substrings
from lacuna.llm.common import Scratch


def plain_near_copies(rows, words=5, percent=80):
    """Ids that stay of (id, text): of texts linked by the similarity of their shingles, found by comparing all pairs, the smallest."""
    sets = {}
    for d, text in rows:
        tokens = (text or "").encode().lower().split()
        sets[d] = frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def test_stages(spark, data):
    scratch, docs, seen = Scratch(spark, "pipeline-test"), spark.read.parquet(f"{data}/documents.parquet"), []
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.table(stage(spark, docs, data), f"stage{number}")
        seen.append([r.asDict() for r in docs.collect()])
        if number < 4:
            assert docs.columns == columns
    clean, single, cut, mixed, packed = seen

    toxic = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").filter("toxic = 0").collect()}
    given = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(toxic & given - {r["doc_id"] for r in clean}) <= 0.03 * len(toxic)

    assert {r["doc_id"] for r in single} == plain_near_copies([(r["doc_id"], r["text"]) for r in clean])

    texts = {r["doc_id"]: r["text"].encode() for r in single}
    removed = {d: n for d, (_, n, _, _) in zip(texts, plain_repeats(list(texts.values()), substrings.PASSAGE), strict=True)}
    after = {r["doc_id"]: r["text"] for r in cut}
    for d, text in texts.items():
        if not removed[d]:
            assert after[d].encode() == text
        elif d in after:
            assert len(text) - removed[d] - 6 <= len(after[d].encode()) <= len(text) - removed[d]
        else:
            assert removed[d] >= len(text.strip()) - 10

    sizes, targets = plain_mix([(r["source"], len(r["text"].encode().split())) for r in cut])
    most = max(len(r["text"].encode().split()) for r in cut)
    for source, target in targets.items():
        assert abs(sum(len(r["text"].encode().split()) for r in mixed if r["source"] == source) - target) <= most

    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    ends = [r for r in packed if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == len(mixed)


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_on_odd_tables(spark, data, odd, empty, rows):
    docs = {"odd": odd, "empty": empty}[rows]
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Scratch(spark, "odd").table(stage(spark, docs, data), f"stage{number}")
        left = [r["doc_id"] for r in docs.collect()]
        assert set(left) <= ids and (number == 4 or docs.columns == columns)
        if rows == "odd":
            assert {2, 3, 4} & set(left) == ({2, 3, 4} if number < 1 else {2}) and None in left  # wordless texts are one group
            assert number > 2 or max(left.count(d) for d in left) == (2 if number == 0 else 1)


def test_passages_of_over_fifty_words_go(spark):
    """51 to 80 words that stand in two documents are cut out, and nothing else is."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.choice([2, 3, 3, 5, 6, 7, 8])))
    texts, planted, short = [], [], 0
    for n in range(60):
        passage = " ".join(word() for _ in range(rng.randint(51, 80)))
        short += len(passage) < 400
        planted.append(passage)
        texts += [" ".join([*(word() for _ in range(60)), passage, *(word() for _ in range(60))]) for _ in range(2)]
    clean = [" ".join(word() for _ in range(150)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_stage(spark, docs, "").collect()}
    assert short > 10  # these are shorter than the strings of ``op8``
    assert [left[len(texts) + i] for i in range(len(clean))] == clean
    for d, text in enumerate(texts):
        assert abs(len(text) - len(left[d]) - len(planted[d // 2])) <= 8 and planted[d // 2][4:-4] not in left[d]
