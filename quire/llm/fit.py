"""Small numpy learners for bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, l1: float, rounds: int = 400, least: np.ndarray | float = -np.inf) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty and a lower bound, by accelerated proximal gradient; (weights, intercept).

    The intercept isn't penalised. Without rows, or with one class only, weights are 0 and the intercept is the
    smoothed log-odds of the label.
    """
    n, k = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    if n == 0 or k == 0 or y.min() == y.max():
        return np.zeros(k), bias
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = np.hstack([x / scale, np.ones((n, 1))])
    probe = np.ones(k + 1)
    for _ in range(20):
        probe = z.T @ (z @ probe)
        probe /= np.linalg.norm(probe)
    step = 1 / (0.25 * np.linalg.norm(z @ probe) ** 2 / n * 1.05)
    low = np.append(np.broadcast_to(np.asarray(least, float), k) * scale if np.ndim(least) else np.full(k, least), -np.inf)
    cut = np.append(np.full(k, l1), 0) * step
    w = look = np.append(np.zeros(k), bias)
    t = 1.0
    for _ in range(rounds):
        grad = z.T @ (sigmoid(z @ look) - y) / n
        new = look - step * grad
        new = np.maximum(np.sign(new) * np.maximum(np.abs(new) - cut, 0), low)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:k] / scale, float(w[k])
