"""Logistic calibration of a few numbers per document; fitted on the driver, a bounded sample only."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (bias last) by Newton's method; without both labels, a constant."""
    if len(y) == 0 or y.min() == y.max():
        return np.append(np.zeros(x.shape[1] if x.ndim == 2 else 1), 0.0 if len(y) == 0 else (8.0 if y[0] else -8.0))
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def apply_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
