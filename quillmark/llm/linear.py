"""Logistic models over sparse rows, fitted with Adam from a bounded sample, and Platt's calibration."""

from __future__ import annotations

import numpy as np


#: Entries that a product takes at once.
BLOCK = 1 << 19


class Rows:
    """Sparse rows: for each entry its row, its column and its value. Products go block by block, so nothing as long as the
    entries is made beside them."""

    def __init__(self, cols: list[np.ndarray], vals: list[np.ndarray]):
        self.n = len(cols)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.array([len(c) for c in cols], np.int64))
        self.col = np.concatenate([np.zeros(0, np.int32), *cols])
        self.val = np.concatenate([np.zeros(0, np.float32), *vals])

    def take(self, keep: np.ndarray) -> Rows:
        to, m, out = np.cumsum(keep, dtype=np.int32) - 1, keep[self.row], Rows([], [])
        out.n, out.row, out.col, out.val = int(keep.sum()), to[self.row[m]], self.col[m], self.val[m]
        return out

    def _blocks(self):
        for lo in range(0, len(self.row), BLOCK):
            yield self.row[lo : lo + BLOCK], self.col[lo : lo + BLOCK], self.val[lo : lo + BLOCK]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for row, col, val in self._blocks():
            out += np.bincount(row, weights=val * w[col], minlength=self.n)
        return out

    def back(self, g: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros(d)
        for row, col, val in self._blocks():
            out += np.bincount(col, weights=val * g[row], minlength=d)
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, **params: tuple[np.ndarray, np.ndarray]) -> None:
        self.t += 1
        for k, (x, g) in params.items():
            m, v = self.state.setdefault(k, [np.zeros_like(x), np.zeros_like(x)])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, d: int, rounds: int = 80, rate: float = 0.05, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of y."""
    w, b, adam = np.zeros(d), np.zeros(1), Adam(rate)
    weight = weight / weight.sum()
    for _ in range(rounds):
        g = weight * (sigmoid(x.dot(w) + b[0]) - y)
        adam.step(w=(w, x.back(g, d) + l2 * w), b=(b, np.array([g.sum()])))
    return w.astype(np.float32), float(b[0])


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores of rows the model didn't see into probabilities (Newton's method, smoothed targets)."""
    if len(z) == 0:
        return 1.0, 0.0
    scale = max(1e-6, float(np.std(z)))
    weight = weight / weight.sum() * len(z)
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, ab = z / scale, np.array([1.0, 0.0])
    for _ in range(60):
        p = sigmoid(ab[0] * x + ab[1])
        g, r = weight * (p - t), weight * p * (1 - p) + 1e-9
        h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * x).sum() + 1e-3 * ab[0], g.sum()])
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(ab[0], 1e-3) / scale), float(ab[1])


def class_weights(y: np.ndarray, counts: dict | None = None) -> np.ndarray:
    """Weights that give both classes the same sum, or with counts the sums that they have among all labelled rows."""
    n = np.bincount(y.astype(int), minlength=2).astype(float)
    want = np.array([1.0, 1.0]) if counts is None else np.array([counts.get(0, 0), counts.get(1, 0)], float)
    return (want / np.maximum(n, 1))[y.astype(int)]
