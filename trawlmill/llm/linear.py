"""Sparse multinomial logistic regression: FTRL-proximal updates with elastic net, and temperature calibration.

Used on bounded training samples inside one task; models are small arrays that predictions close over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: row i has features index[start[i]:start[i+1]] with the values beside them."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.start)[rows]
        start = np.r_[0, np.cumsum(size)]
        at = np.arange(start[-1]) - np.repeat(start[:-1], size) + np.repeat(self.start[rows], size)
        return Rows(start, self.index[at], self.value[at])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of value x weights by row; weights: features x classes."""
        out = np.zeros((len(self), weights.shape[1]))
        owner = np.repeat(np.arange(len(self)), np.diff(self.start))
        for k in range(weights.shape[1]):
            out[:, k] = np.bincount(owner, self.value * weights[self.index, k], minlength=len(self))
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: Rows, label: np.ndarray, classes: int, features: int, *, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0,
    l1: float = 0.5, l2: float = 1.0, weight: np.ndarray | None = None, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts; one row at a time in a fixed random order."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
    random = np.random.default_rng(seed)
    weight = np.ones(len(rows)) if weight is None else weight
    own = np.eye(classes)

    def current(zj: np.ndarray, nj: np.ndarray, free: bool = False) -> np.ndarray:
        least = 0.0 if free else l1
        return -np.sign(zj) * np.maximum(np.abs(zj) - least, 0) / ((beta + np.sqrt(nj)) / alpha + (0.0 if free else l2))

    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            a, b = rows.start[i], rows.start[i + 1]
            j, x = rows.index[a:b], rows.value[a:b]
            zj, nj = z[j], n[j]
            w, w0 = current(zj, nj), current(z[-1], n[-1], free=True)
            error = (softmax(x @ w + w0) - own[label[i]]) * weight[i]
            g = x[:, None] * error
            z[j] = zj + g - (np.sqrt(nj + g * g) - np.sqrt(nj)) / alpha * w
            n[j] = nj + g * g
            z[-1] += error - (np.sqrt(n[-1] + error * error) - np.sqrt(n[-1])) / alpha * w0
            n[-1] += error * error
    return current(z[:-1], n[:-1]), current(z[-1], n[-1], free=True)


def loss(scores: np.ndarray, label: np.ndarray) -> float:
    """Log loss against targets a little below 1, so that a sample without errors doesn't make the scores boundless."""
    logs = np.log(np.maximum(softmax(scores), 1e-12))
    n, classes = scores.shape
    spare = 1 / (n + 2)
    own = logs[np.arange(n), label]
    return float(-((1 - spare) * own + spare * (logs.sum(axis=1) - own) / max(classes - 1, 1)).mean())


def temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the scores with the least log loss on rows that the fit didn't see; golden-section search on its logarithm."""
    if not len(label):
        return 1.0
    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(scores / np.exp(a), label), loss(scores / np.exp(b), label)
    while high - low > 1e-3:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(scores / np.exp(a), label)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(scores / np.exp(b), label)
    return float(np.exp((low + high) / 2))
