"""A small ridge logistic regression on the driver, for bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Line:
    """Standardised inputs times weights, plus a constant: a logit."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40, weight: np.ndarray | None = None) -> Line:
    """Newton's steps; ``weight`` counts rows."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    c = np.ones(len(y)) if weight is None else weight
    mean = x.mean(0)
    scale = x.std(0)
    scale[scale < 1e-9] = 1.0
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (c * (y - p)) - penalty * w
        step = np.linalg.solve((a * (c * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), grad)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Line(mean, scale, w)
