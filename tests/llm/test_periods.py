"""Runs against a count of every stretch, and the query against a plain version of its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lacuna.llm import periods
from lacuna.llm.queries import QUERIES


def plain_runs(words, powers=4, least=6):
    """Every longest stretch of every lag whose smallest period is that lag."""
    out, n = [], len(words)
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            smaller = any(all(words[j] == words[j + d] for j in range(start, start + length - d)) for d in range(1, q)) if length >= max(least, powers * q) else True
            if not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_text(rng):
    letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 8, 40]))]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        block = [rng.choice(letters) for _ in range(rng.randint(1, 45))]
        tail = (block * 9)[: rng.randint(1, 8 * len(block))]
        words += tail + [rng.choice(letters) for _ in range(rng.randint(0, 9))]
    return words


def test_runs_equal_every_stretch():
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(400)]
    found = periods.runs_of(texts)
    assert found == [plain_runs(t) for t in texts]
    assert max(q for runs in found for _, _, q in runs) > 32
    assert [periods.runs_of([t])[0] for t in texts[:50]] == found[:50]


def test_each_scale_has_seeds():
    """Runs of four periods and not a word more, for periods on both sides of each scale's limits."""
    rng = random.Random(2)
    for period in (7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 127, 128, 300, 1023, 1024):
        block = [str(rng.randrange(50)).encode() for _ in range(period - 1)] + [b"x"]
        words = [b"a", b"b", *(block * 4), b"c"]
        assert (2, 4 * period, period) in periods.runs_of([words])[0]
        assert all(q != period for _, _, q in periods.runs_of([words[:-2] + [b"d"]])[0])


def test_smallest_period():
    x = np.array([1, 2] * 40)
    assert not periods.is_smallest(x, 0, 4) and periods.is_smallest(x, 0, 2)
    assert periods.find_runs(x, 80) == [(0, 80, 2)]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    short = [(d, t) for d, t in docs if len((t or "").split()) < 1500]
    got = rows_of(QUERIES["op12_runs"](spark, data))
    small = {d for d, _ in short}
    assert len(got) == len(docs) and len(short) > 150
    assert [r for r in got if r[0] in small] == sorted((plain_row(*r) for r in short), key=str)
    assert sum(r[1] > 0 for r in got) > len(docs) / 20


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_tables(spark, odd, empty, rows):
    docs = {"odd": odd, "empty": empty}[rows]
    got = rows_of(periods.digests(periods.collapse_runs(docs, prepare=periods.repeat_tail)))
    plain = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 5]
    assert [r for r in got if r[0] != 5] == sorted((plain_row(*r) for r in plain), key=str)
    if rows == "odd":
        (long,) = [r for r in got if r[0] == 5]
        assert long[1:6] == (1, 0, 30_000, 1, 30_000_000)
