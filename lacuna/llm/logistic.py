"""Small logistic models, fitted on bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class SparseRows:
    """Rows of feature numbers that are present."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n: int):
        self.row, self.feature, self.n = row, feature.astype(np.int64), n

    @classmethod
    def of(cls, rows: list[list[int]] | pa.ListArray) -> SparseRows:
        """From lists, or from an Arrow array of lists."""
        if isinstance(rows, pa.ListArray):
            sizes = pa.compute.list_value_length(rows).to_numpy(zero_copy_only=False)
            return cls(np.repeat(np.arange(len(rows)), sizes), rows.flatten().to_numpy(zero_copy_only=False), len(rows))
        return cls(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([f for r in rows for f in r], dtype=np.int64), len(rows))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], self.n)

    def back(self, g: np.ndarray, n_features: int) -> np.ndarray:
        return np.bincount(self.feature, g[self.row], n_features)


def fit_sparse(
    x: SparseRows, labels: np.ndarray, n_features: int, gone: SparseRows | None = None, come: SparseRows | None = None, pull: float = 1.0, l2: float = 1e-4, steps: int = 400, rate: float = 0.1
) -> tuple[np.ndarray, float]:
    """Weights and bias. ``gone`` and ``come`` are features that counterfactuals lose and gain: the squared change of the score is penalised."""
    none = SparseRows.of([])
    n, left, right = max(1, x.n), gone or none, come or none
    w, b = np.zeros(n_features), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        off = (sigmoid(x.dot(w) + b) - labels) / n
        grad = x.back(off, n_features) + l2 * w
        if left.n:
            change = 2 * pull * (left.dot(w) - right.dot(w)) / left.n
            grad += left.back(change, n_features) - right.back(change, n_features)
        g = np.append(grad, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def fit_dense(x: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, l2: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of standardised columns by Newton's method; the last one is the bias."""
    one = np.column_stack([x, np.ones(len(x))])
    w, c = np.zeros(one.shape[1]), np.ones(len(x)) if weights is None else weights
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(one @ w)
        grad = one.T @ (c * (p - labels)) / len(x) + ridge * w
        hess = (one * (c * p * (1 - p))[:, None]).T @ one / len(x) + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w
