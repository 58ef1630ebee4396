"""Regime probabilities from a Gaussian mixture with full covariances, fitted per series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyfold.shipping import ship

ROUNDS, TOLERANCE, RIDGE, SEED = 200, 1e-3, 1e-5, 42


def _log_density(x: np.ndarray, weight, mean, cov) -> np.ndarray:
    out = np.empty((len(x), len(weight)))
    for j in range(len(weight)):
        root = np.linalg.cholesky(cov[j])
        z = np.linalg.solve(root, (x - mean[j]).T)
        out[:, j] = np.log(weight[j]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _responsibilities(logs: np.ndarray) -> tuple[np.ndarray, float]:
    top = logs.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
    return np.exp(logs - total), float(total.mean())


def fit_mixture(x: np.ndarray, states: int, seed: int = SEED):
    """Weights, means and covariances by expectation maximisation from a seeded k-means start."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-12
    centre = x[rng.choice(len(x), states, replace=False)]
    for _ in range(50):
        own = (((x[:, None] - centre) / scale) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[own == j].mean(axis=0) if (own == j).any() else centre[j] for j in range(states)])
        if np.allclose(moved, centre):
            break
        centre = moved
    share, before = np.eye(states)[own], -np.inf
    for _ in range(ROUNDS):
        size = share.sum(axis=0) + 1e-10
        weight, mean = size / size.sum(), (share.T @ x) / size[:, None]
        cov = np.array([((x - mean[j]).T * share[:, j]) @ (x - mean[j]) / size[j] + RIDGE * np.eye(x.shape[1]) for j in range(states)])
        share, score = _responsibilities(_log_density(x, weight, mean, cov))
        if abs(score - before) < TOLERANCE:
            break
        before = score
    return weight, mean, cov


def regime_probabilities(df: DataFrame, features: list[str], states: int, train: int, keys) -> DataFrame:
    """Adds p_bull and p_bear, the posteriors of the states with the highest and lowest mean of the
    first feature. The fit uses the valid rows among the first `train` bars; with fewer than
    max(50, 10 * states) of them both stay null."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        x = table.select(features).to_pandas().to_numpy(float)
        valid = np.isfinite(x).all(axis=1)
        bull, bear = np.full(len(x), np.nan), np.full(len(x), np.nan)
        first = x[:train][valid[:train]]
        if len(first) >= max(50, states * 10):
            weight, mean, cov = fit_mixture(first, states)
            share, _ = _responsibilities(_log_density(x[valid], weight, mean, cov))
            order = np.argsort(mean[:, 0])
            bull[valid], bear[valid] = share[:, order[-1]], share[:, order[0]]
        for name, values in (("p_bull", bull), ("p_bear", bear)):
            table = table.append_column(name, pa.array(pd.Series(values), pa.float64(), from_pandas=True))
        return table

    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("p_bull", T.DoubleType()), T.StructField("p_bear", T.DoubleType())])
    return df.groupBy(*keys).applyInArrow(run, schema)
