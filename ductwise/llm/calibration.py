"""Logistic calibration of a few features, for scores between 0 and 1."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Weighted logistic regression by Newton steps with a small ridge; features are scaled by their spread."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, steps: int = 50):
        x = np.asarray(features, float).reshape(len(labels), -1)
        self.centre, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x, y, w = self._inputs(x), np.asarray(labels, float), np.asarray(weights, float)
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        self.weights = np.zeros(x.shape[1])
        for _ in range(steps if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (w * (p - y)) + penalty * self.weights
            curve = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            self.weights -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))])

    def __call__(self, features: np.ndarray) -> np.ndarray:
        # column by column, so that a row's rounding doesn't depend on its place
        total = np.zeros(len(features))
        for column, weight in zip(self._inputs(np.asarray(features, float)).T, self.weights.tolist()):
            total = total + column * weight
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def class_weights(labels: np.ndarray, shares: dict[int, float]) -> np.ndarray:
    """Weights that give each class of a balanced sample its share of all labelled rows."""
    y = np.asarray(labels)
    n = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    return np.where(y == 1, shares.get(1, 0.5) / n[1], shares.get(0, 0.5) / n[0]) * len(y)
