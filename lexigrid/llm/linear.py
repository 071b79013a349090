"""Small dense logistic models and the choice of their features, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the intercept last, of ridge logistic regression by Newton's method.

    One class alone gives a constant model near that class's share.
    """
    n, d = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(d + 1)
    w[d] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w
    a = np.c_[x, np.ones(n)]
    ridge = np.full(d + 1, l2)
    ridge[d] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * v * v).sum())

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-3 and (new := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-3 or now - new < 1e-7 * (1 + abs(now)):
            break
        w, now = w - size * step, new
    return w


def chi_square(present: np.ndarray, present_positive: np.ndarray, n: int, positive: int) -> np.ndarray:
    """Statistic of each word's presence against the label, from document counts."""
    a = present_positive.astype(float)
    b = present - a
    c, d = positive - a, (n - positive) - b
    bottom = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(bottom > 0, n * (a * d - b * c) ** 2 / np.maximum(bottom, 1e-12), 0.0)
