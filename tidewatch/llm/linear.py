"""Sparse logistic regression with follow-the-regularised-leader (FTRL-proximal) updates, trained inside Spark tasks."""

from __future__ import annotations

import numpy as np

#: Size of the hashed feature space.
BITS = 18


class Ftrl:
    """Per-coordinate FTRL-proximal: a weight stays exactly zero until its evidence passes ``l1``."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z = np.zeros(size)
        self.n = np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example: distinct feature numbers, their values and the label."""
        w = self.weights(i)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[i]
        after = n + g * g
        self.z[i] += g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[i] = after


def sigmoid(v):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int, seed: int, **how) -> np.ndarray:
    """Weights from examples (features, values, label), in a fixed random order per epoch."""
    model = Ftrl(size, **how)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            model.learn(*rows[k])
    return model.weights().astype(np.float32)


def dots(w: np.ndarray, i: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sparse dot products of many texts: their features end to end, ``first`` marks where each begins."""
    c = np.concatenate(([0.0], np.cumsum(w[i] * x, dtype=np.float64)))
    return c[first[1:]] - c[first[:-1]]
