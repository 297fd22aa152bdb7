"""SimHash groups, repeated strings, and their parts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from lacuna.llm import graph, lyndon, simhash, substrings


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """Smallest id that each fingerprint reaches, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def test_groups_equal_all_pairs(spark, scratch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([2, 30, 200]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), scratch).collect()}
    prints = [(d, plain_fingerprint(t)) for d, t in docs]
    least = plain_groups(prints)
    assert got == {d: (f, least[f]) for d, f in prints}
    assert len({c for _, c in got.values()}) < len(docs)


def test_blocks_lose_no_link(spark, scratch, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(5)
    center = rng.getrandbits(64)
    fps = set()
    while len(fps) < 90:
        f = center
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    entries = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in graph.components(simhash.links(entries, scratch), scratch).collect()}
    expected = plain_groups([(f, f) for f in fps])
    parts = lambda of: sorted(sorted(f for f in fps if of(f) == k) for k in {of(f) for f in fps})
    assert parts(lambda f: roots.get(f, f)) == parts(lambda f: expected[f])


def test_near_duplicates_of_odd_tables(odd, empty, scratch):
    rows = simhash.near_duplicates(odd, scratch).collect()
    assert len(rows) == 10
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert by[6, next(f for d, f in by if d == 6)] == 1  # copies of document 1
    assert {c for (d, f), c in by.items() if f == 0 and d in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(empty, scratch).count() == 0
    kept = simhash.keep_one(odd, scratch)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8]


def test_suffix_array_by_grouping():
    rng = random.Random(5)
    for t in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 30))] * (3 if t % 3 == 0 else 1) + [0]
        order = lyndon.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        shared = lyndon.common_prefixes(text, order)
        for i in range(0, len(text), 4):
            best = 0
            for j in range(len(text)):
                h = 0
                while j != i and max(i, j) + h < len(text) and text[i + h] == text[j + h]:
                    h += 1
                best = max(best, h)
            assert shared[i] == best


def plain_repeats(texts, length=400):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh é.\n") for _ in range(n))
    bases, out = [noise(900) for _ in range(5)], []
    for _ in range(60):
        k, b = rng.random(), rng.choice(bases)
        at = rng.randrange(450)
        if k < 0.2:
            out.append(b)
        elif k < 0.5:
            chars = list(b)
            for _ in range(rng.randint(1, 3)):
                chars[rng.randrange(len(chars))] = rng.choice("XYZ")
            out.append("".join(chars))
        elif k < 0.7:
            out.append(noise(rng.randint(0, 500)) + b[at : at + rng.randint(380, 450)] + noise(rng.randint(0, 500)))
        elif k < 0.8:
            out.append(f"abc{rng.randint(0, 3)} " * rng.randint(60, 200) + noise(rng.randint(0, 30)))
        else:
            out.append(b[:500] + noise(10) + b[: rng.randint(380, 500)])
    return [*out, "", None, "abc", "x" * 1200, "x" * 399, "x" * 400]


@pytest.mark.parametrize("crowd", [substrings.CROWD, 3])
def test_repeats_equal_counting_all_windows(spark, scratch, mixed_texts, crowd):
    docs = spark.createDataFrame(list(enumerate(mixed_texts)), "doc_id long, text string").repartition(5)
    rows = substrings.digests(*substrings.find_repeats(docs, scratch, crowd=crowd)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == dict(enumerate(plain_repeats([(t or "").encode() for t in mixed_texts])))


def test_query_equals_counting_all_windows(spark, data):
    from lacuna.llm.queries import QUERIES

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op8_substrings"](spark, data).collect()}
    assert got == dict(zip(docs, plain_repeats(list(docs.values())), strict=True))


def test_repeats_of_odd_tables(odd, empty, scratch):
    rows = substrings.digests(*substrings.find_repeats(odd, scratch)).collect()
    assert len(rows) == 10 and {r["doc_id"]: r["n_removed"] for r in rows}[5] == 150_000
    assert substrings.digests(*substrings.find_repeats(empty, scratch)).count() == 0
    left = substrings.remove_repeats(odd, scratch)
    assert left.columns == odd.columns
    # documents that lose all go, those without words stay
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"]) == [2, 3, 4, 7, 8]
