"""Logistic regression on dense features, and probability calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-5, rate: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the mean log loss with a ridge penalty.

    Deterministic.  One class only (or no rows) gives zero weights and a bias
    at the smoothed log odds.
    """
    w = np.zeros(x.shape[1])
    odds = (y.sum() + 0.5) / (len(y) - y.sum() + 0.5)
    b = float(np.log(odds))
    if len(y) == 0 or y.min() == y.max():
        return w, b
    bound = float((x.astype(np.float32) ** 2).sum(axis=1).max()) + 1.0
    step = rate or 4.0 / bound
    w_at, b_at, momentum = w.copy(), b, 1.0
    for _ in range(rounds):
        error = sigmoid(x @ w_at.astype(x.dtype) + b_at) - y
        new_w = w_at - step * ((error.astype(x.dtype) @ x) / len(y) + ridge * w_at)
        new_b = b_at - step * float(error.mean())
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        w_at = new_w + (momentum - 1) / grown * (new_w - w)
        b_at = new_b + (momentum - 1) / grown * (new_b - b)
        w, b, momentum = new_w, new_b, grown
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset that turn scores into probabilities, with smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = z.mean(), max(float(z.std()), 1e-9)
    s = (z - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton's method in two dimensions
        p = sigmoid(a * s + b)
        g = np.array([((p - target) * s).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * s * s).sum() + 1e-6, (v * s).sum()], [(v * s).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move /= max(1.0, float(np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    return a / spread, b - a * mean / spread
