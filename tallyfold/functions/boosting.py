"""Boosted trees for two classes, small enough to be fitted inside a grouped call.

Each tree is grown on the residuals of the logistic loss by the split of least squared error, to a
fixed depth; its leaves take one Newton step. Of equally good splits the first column's lowest one
counts, so a fit depends on its rows alone. Scaling columns would change nothing.
"""

from __future__ import annotations

import numpy as np


def _split(x: np.ndarray, order: np.ndarray, residual: np.ndarray) -> tuple[int, float] | None:
    """Column and threshold of the best split of rows whose columns are sorted by order; None if no
    split lowers the error."""
    n = len(residual)
    sums = np.cumsum(residual[order], axis=0)[:-1]
    total, left = residual.sum(), np.arange(1, n)[:, None]
    gain = sums**2 / left + (total - sums) ** 2 / (n - left) - total**2 / n
    values = np.take_along_axis(x, order, axis=0)
    gain[values[1:] <= values[:-1]] = -np.inf
    column = int(np.argmax(gain.max(axis=0, initial=-np.inf)))
    if n < 2 or gain[:, column].max() <= 1e-12:
        return None
    at = int(np.argmax(gain[:, column]))
    return column, float((values[at, column] + values[at + 1, column]) / 2)


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int) -> tuple:
    """A leaf (value,) or (column, threshold, below, above)."""
    found = _split(x, np.argsort(x, axis=0, kind="stable"), residual) if depth and len(x) > 1 else None
    if found is None:
        total = weight.sum()
        return (residual.sum() / total if total > 1e-150 else 0.0,)
    low = x[:, found[0]] <= found[1]
    return (*found, _grow(x[low], residual[low], weight[low], depth - 1), _grow(x[~low], residual[~low], weight[~low], depth - 1))


def _values(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    column, threshold, below, above = tree
    return np.where(x[:, column] <= threshold, _values(below, x), _values(above, x))


class BoostedTrees:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 3, rate: float = 0.1):
        share = y.mean()
        self.start, self.rate, self.trees = float(np.log(share / (1 - share))), rate, []
        score = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(_grow(x, y - p, p * (1 - p), depth))
            score += rate * _values(self.trees[-1], x)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the second class."""
        return self.start + self.rate * sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.score(x) > 0).astype(float)
