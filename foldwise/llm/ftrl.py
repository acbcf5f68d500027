"""Follow-the-regularised-leader for logistic models over sparse rows (one-class or softmax), on a bounded sample."""

from __future__ import annotations

import numpy as np

SparseRow = tuple[np.ndarray, np.ndarray]  # distinct feature indices, values


class Ftrl:
    """Per-coordinate proximal updates with an elastic-net penalty (``l1``, ``l2``).

    ``classes == 1`` is the binary model (one weight vector); else a softmax over ``classes`` vectors. The last
    feature index is the bias, which is not penalised.
    """

    def __init__(self, dims: int, classes: int = 1, alpha: float = 0.5, beta: float = 1.0,
                 l1: float = 0.0, l2: float = 0.0) -> None:
        self.dims, self.classes = dims, classes
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((classes, dims + 1))
        self.n = np.zeros((classes, dims + 1))

    def _weights_at(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[:, idx], self.n[:, idx]
        l1 = np.where(idx == self.dims, 0.0, self.l1)
        l2 = np.where(idx == self.dims, 0.0, self.l2)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0.0) / ((self.beta + np.sqrt(n)) / self.alpha + l2)

    def weights(self) -> np.ndarray:
        return self._weights_at(np.arange(self.dims + 1))

    def update(self, row: SparseRow, label: int) -> None:
        idx = np.append(row[0], self.dims)
        val = np.append(row[1], 1.0)
        w = self._weights_at(idx)
        raw = w @ val
        if self.classes == 1:
            err = sigmoid(raw) - label
        else:
            err = softmax(raw)
            err[label] -= 1.0
        g = err[:, None] * val
        n = self.n[:, idx]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, idx] += g - sigma * w
        self.n[:, idx] = n + g * g

    def fit(self, rows: list[SparseRow], labels: list[int], passes: int) -> "Ftrl":
        for p in range(passes):
            for i in np.random.default_rng(p).permutation(len(rows)):
                self.update(rows[i], labels[i])
        return self


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def temperature(logits: np.ndarray, labels: np.ndarray, steps: int = 60) -> float:
    """The temperature with the least log loss on held-back rows (``logits``: classes x rows), by golden section."""
    if logits.size == 0:
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[labels, np.arange(len(labels))], 1e-12)).mean() + 1e-4 * log_t * log_t)

    lo, hi, g = np.log(0.02), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(steps):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
