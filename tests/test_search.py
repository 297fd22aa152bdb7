"""Search with skipped blocks against scores of all pairs."""

import numpy as np
import pytest

from lacuna.operators import evaluate, search


def table(spark, vectors, groups=None, keys=None):
    rows = [(i, v.tolist(), (groups or {}).get(i, i % 3), (keys or {}).get(i, "k")) for i, v in vectors.items()]
    return spark.createDataFrame(rows, "id long, vec array<double>, group long, key string").repartition(3)


def plain(queries, rows, k, metric, keep):
    out = []
    for q, a in queries.items():
        scored = []
        for r, b in rows.items():
            if keep(q, r):
                if metric == "cosine":
                    size = np.linalg.norm(a) * np.linalg.norm(b)
                    s = round(float(a @ b / size), 9) if size else 0.0
                else:
                    s = -round(float(np.linalg.norm(a - b)), 9)
                scored.append((-s, r))
        out += [(q, r, round(-s, 9), i) for i, (s, r) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def planted(seed, n=240, clusters=8, dim=6, noise=0.05):
    """Clusters, equal vectors among them, zero vectors, and one heap of copies larger than a block."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dim))
    vectors = {i: middles[i % clusters] * rng.uniform(1, 3) + noise * rng.normal(size=dim) for i in range(n)}
    vectors |= {n + i: vectors[i % 3].copy() for i in range(9)} | {n + 20: np.zeros(dim), n + 21: np.zeros(dim)}
    return vectors | {1000 + i: middles[0].copy() for i in range(50)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("other_group, itself", [(False, False), (True, False), (False, True)])
def test_equals_all_pairs(spark, metric, other_group, itself):
    rows = planted(1)
    queries = {i: v for i, v in rows.items() if i % 6 == 0 or i == 261} | {2000: np.ones(6)}
    group = lambda i: i % 3
    hits, visits, blocks = search.phases(table(spark, queries), table(spark, rows), 4, metric, ["key"], other_group, itself, block=16, n_centres=9)
    got = sorted((r["source"], r["target"], round(r["score"], 9), r["rank"]) for r in search.ranked(hits, 4, ["key"]).collect())
    keep = lambda q, r: (itself or q != r) and (not other_group or group(q) != group(r))
    assert got == plain(queries, rows, 4, metric, keep)
    n_blocks = blocks.rings.selectExpr("sum(parts)").first()[0]
    assert n_blocks > 9 and blocks.rows.groupBy("base", "part").count().agg({"count": "max"}).first()[0] <= 40
    if not other_group:
        assert visits.count() < 0.5 * len(queries) * n_blocks


def test_most_blocks_are_skipped_on_clusters(spark):
    rows = planted(3, n=960, clusters=24, noise=0.01)
    del rows[980], rows[981]  # zero vectors are never skipped
    queries = {i: v for i, v in rows.items() if i % 10 == 0}
    _, visits, blocks = search.phases(table(spark, queries), table(spark, rows), 5, block=24, n_centres=24)
    n_blocks = blocks.rings.selectExpr("sum(parts)").first()[0]
    assert n_blocks > 30 and visits.count() < 0.15 * len(queries) * n_blocks


def test_places_at_poles_and_date_line(spark):
    """The nearest place across the date line and around the poles, with a hot place that many share; queries visit few blocks."""
    rng = np.random.default_rng(8)
    places = {i: (float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(500)}
    places |= {500 + i: (10.0, 20.0) for i in range(60)}
    places |= {600: (0.0, 179.9), 601: (0.0, -179.9), 602: (89.9, 0.0), 603: (89.9, 180.0), 604: (-90.0, 5.0), 605: (-90.0, -100.0), 606: (None, 1.0)}
    rows = spark.createDataFrame([(i, *p) for i, p in places.items()], "entity long, latitude double, longitude double").repartition(3)
    got = {r["entity"]: r["km"] for r in evaluate.min_haversine_km(rows, rows).collect()}
    known = {i: np.radians(p) for i, p in places.items() if p[0] is not None}
    at = np.array(list(known.values()))

    def km(i):
        lat, lon = known[i]
        a = np.sin((at[:, 0] - lat) / 2) ** 2 + np.cos(lat) * np.cos(at[:, 0]) * np.sin((at[:, 1] - lon) / 2) ** 2
        d = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, a)))
        return min(x for x, j in zip(d, known, strict=True) if j != i)

    assert set(got) == set(known) and all(abs(got[i] - km(i)) < 1e-3 for i in known)
    assert got[600] < 30 and got[602] < 30 and got[604] < 1e-3 and got[520] < 1e-3
    points = {i: np.array([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)]) for i, (a, b) in known.items()}
    _, visits, blocks = search.phases(table(spark, points), table(spark, points), 1, "euclidean", block=16, n_centres=36)
    assert visits.count() < 0.12 * len(points) * blocks.rings.selectExpr("sum(parts)").first()[0]


def test_keys_are_kept_apart(spark):
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=3) for i in range(60)}
    key = {i: "ab"[i % 2] for i in range(60)} | {100: "c"}
    queries = {i: rows[i] for i in range(0, 60, 7)} | {100: np.ones(3)}
    got = search.top_k(table(spark, queries, keys=key), table(spark, rows, keys=key), 3, "euclidean", ["key"], block=8)
    found = sorted((r["source"], r["target"], round(r["score"], 9), r["rank"]) for r in got.collect())
    assert found == plain(queries, rows, 3, "euclidean", lambda q, r: q != r and key[q] == key[r])
    empty = search.top_k(table(spark, queries), table(spark, rows).limit(0), 3)
    assert empty.count() == 0 and search.top_k(table(spark, rows).limit(0), table(spark, rows), 3).count() == 0
