"""Linear discriminants and averaged perceptrons on NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RIDGE = 1e-4


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def decide(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, np.float64) @ self.weights + self.bias


def train_lda(x: np.ndarray, y: np.ndarray, gamma: float = RIDGE) -> Linear:
    """Discriminant of two classes; the covariance is drawn towards its mean variance by gamma."""
    x, y = np.asarray(x, np.float64), np.asarray(y, bool)
    a, b = x[y], x[~y]
    centered = np.r_[a - a.mean(axis=0), b - b.mean(axis=0)]
    covariance = centered.T @ centered / max(1, len(x) - 2)
    n = x.shape[1]
    covariance = (1 - gamma) * covariance + gamma * np.trace(covariance) / n * np.eye(n)
    w = np.linalg.lstsq(covariance, a.mean(axis=0) - b.mean(axis=0), rcond=None)[0]
    return Linear(w, -float(w @ (a.mean(axis=0) + b.mean(axis=0)) / 2))


def train_perceptron(x: np.ndarray, y: np.ndarray, rounds: int = 100_000, rate: float = 1.0) -> Linear:
    """Mean of the weights over all steps; ends early once a round makes no mistake."""
    x, y = np.asarray(x, np.float64), np.where(np.asarray(y, bool), 1.0, -1.0)
    w, b, sum_w, sum_b, steps = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
    for _ in range(rounds):
        wrong = 0
        for row, label in zip(x, y):
            if label * (row @ w + b) <= 0:
                w = w + rate * label * row
                b += rate * label
                wrong += 1
            sum_w += w
            sum_b += b
            steps += 1
        if not wrong:
            break
    return Linear(sum_w / max(1, steps), sum_b / max(1, steps))
