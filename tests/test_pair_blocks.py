"""All pairs, made in pieces of products of matrices: the same as one by one, for odd vectors too."""

import math

import numpy as np
import pytest

from lacuna.operators import vectors
from lacuna.plans import QUERIES


def plain(x, y, metric):
    if x is None or y is None or len(x) != len(y) or any(v is None for v in (*x, *y)):
        return 1.0 if metric == "cosine" else None
    x, y = np.array(x), np.array(y)
    if metric == "hamming":
        return float((x != y).mean())
    if metric == "euclidean":
        return float(np.sqrt(((x - y) ** 2).sum()))
    size = np.linalg.norm(x) * np.linalg.norm(y)
    return min(2.0, max(0.0, 1 - float(x @ y) / size)) if size else 1.0


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "hamming"])
@pytest.mark.parametrize("space", [None, "space"])
def test_equals_pair_by_pair(spark, monkeypatch, metric, space):
    monkeypatch.setattr(vectors, "MOST_BLOCK", 20)
    monkeypatch.setattr(vectors, "PAIRS", 37)
    rng = np.random.default_rng(7)
    vecs = np.round(rng.normal(size=(70, 5)), 1).tolist()
    vecs[20:30] = vecs[:10]  # equal ones
    vecs[30] = (np.array(vecs[0]) + 1e-9).tolist()  # nearly equal
    vecs[31], vecs[32], vecs[33] = [0.0] * 5, [1e6] * 5, [1e6, 1e6, 1e6, 1e6, 1e6 + 1e-3]
    vecs[34], vecs[35], vecs[36] = None, [1.0, None, 2.0, 0.0, 0.0], [1.0, 2.0]
    rows = [(i * 3 - 50, "ab"[i % 3 == 0], v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id long, space string, vec array<double>")
    got = vectors.pairwise_distance(df, metric, space).collect()
    expected = {(a[0], b[0]): (a[1], plain(a[2], b[2], metric)) for a in rows for b in rows if a[0] < b[0] and (not space or a[1] == b[1])}
    assert len(got) == len(expected)
    for r in got:
        s, d = expected[r["source"], r["target"]]
        assert (r["d"] is None) == (d is None) and (d is None or math.isclose(r["d"], d, rel_tol=1e-7, abs_tol=1e-14 if metric != "cosine" else 1e-12))
        assert not space or r["space"] == s


@pytest.mark.parametrize("name", ["v2_pairwise_cosine", "v2b_pairwise_euclidean", "v2c_pairwise_hamming", "v3_distances_all", "v4b_candidate_pairs"])
def test_no_pair_goes_through_functions_of_lists(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "bround" not in plan
