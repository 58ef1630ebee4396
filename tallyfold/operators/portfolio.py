"""Portfolios: merged trades, weights from daily returns, weighted results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.gram import correlation, covariance, pair_sums
from tallyfold.functions.scan import DAYS, running
from tallyfold.operators.metrics import daily_changes
from tallyfold.shipping import ship

#: Exits at one instant are taken in this order.
ORDER = ("exit_time", "asset", "entry_time")


def merged(trades: DataFrame, keys=("group", "tf"), value: str = "pnl_points", days: int = DAYS) -> DataFrame:
    """trades with `equity`, their running sum over all assets of a key, in order of exit. A key is
    summed in blocks of so many days, so a large one is many tasks."""
    return running(trades, keys, ORDER, value, "equity", days)


def _lately(equity: DataFrame, lookback: int, keys) -> DataFrame:
    """Daily changes of the last `lookback` days on which any asset has one."""
    changes = daily_changes(equity, (*keys, "asset"))
    days = changes.select(*keys, "day").distinct()
    kept = days.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))).where(F.col("r") <= lookback).drop("r")
    return changes.join(kept, [*keys, "day"])


def covariances(changes: DataFrame, keys=("group", "tf")) -> DataFrame:
    """keys, a, b and their sample covariance and correlation over the days both have."""
    return pair_sums(changes, keys, "asset", "daily_return").select(*keys, "a", "b", covariance().alias("covariance"), correlation().alias("correlation"))


def correlation_weights(equity: DataFrame, lookback_days: int = 60, method: str = "inv_vol", keys=("group", "tf")) -> DataFrame:
    """keys, asset and weight. Methods: equal, inv_vol, min_var; others, and fewer than five days,
    mean equal. min_var falls back to inv_vol if the matrix is singular or incomplete."""
    keys = tuple(keys)
    assets = equity.select(*keys, "asset").distinct()
    whole = Window.partitionBy(*keys)
    equal = F.lit(1.0) / F.count(F.lit(1)).over(whole)
    if method not in ("inv_vol", "min_var"):
        return assets.withColumn("weight", equal)
    changes = _lately(equity, lookback_days, keys)
    days = changes.groupBy(*keys).agg(F.count_distinct("day").alias("days"))
    spread = changes.groupBy(*keys, "asset").agg(F.expr("1.0D / nullif(stddev_samp(daily_return), 0D)").alias("inverse"))
    rows = assets.join(spread, [*keys, "asset"], "left").join(days, list(keys), "left")
    share = F.try_divide(F.coalesce("inverse", F.lit(0.0)), F.sum("inverse").over(whole))
    inverse = rows.select(*keys, "asset", F.when(F.coalesce("days", F.lit(0)) < 5, equal).otherwise(F.coalesce(share, equal)).alias("weight"), F.coalesce("days", F.lit(0)).alias("days"))
    if method == "inv_vol":
        return inverse.drop("days")
    schema = assets.withColumn("weight", F.lit(0.0)).schema

    def solve(members: pa.Table, pairs: pa.Table) -> pa.Table:
        members = members.sort_by("asset")
        names, weights = members.column("asset").to_pylist(), members.column("weight").to_pylist()
        if members.num_rows > 1 and members.column("days")[0].as_py() >= 5:
            place = {a: i for i, a in enumerate(names)}
            matrix = np.full((len(names), len(names)), np.nan)
            for a, b, c in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "covariance")), strict=True):
                if c is not None:
                    matrix[place[a], place[b]] = c
            weights = _least_variance(matrix) or weights
        return pa.table({c: members.column(c) for c in (*keys, "asset")} | {"weight": pa.array(weights, pa.float64())})

    # one small matrix per key: as many rows as the key has assets
    ship(equity.sparkSession)
    return inverse.groupBy(*keys).cogroup(covariances(changes, keys).groupBy(*keys)).applyInArrow(solve, schema)


def _least_variance(matrix: np.ndarray) -> list[float] | None:
    """Weights of least variance, negative ones 0; None for an incomplete or singular matrix."""
    if not np.isfinite(matrix).all():
        return None
    try:
        raw = np.linalg.solve(matrix, np.ones(len(matrix)))
    except np.linalg.LinAlgError:
        return None
    raw = np.maximum(raw / raw.sum() if raw.sum() else raw, 0.0)
    return (raw / raw.sum()).tolist() if raw.sum() > 0 else None


def weighted_portfolio(trades: DataFrame, weights: DataFrame, keys=("group", "tf")) -> DataFrame:
    """trades with weight (0 if the asset has none), pnl_weighted and the portfolio's equity."""
    joined = trades.join(F.broadcast(weights.select(*keys, "asset", "weight")) if _few(weights) else weights, [*keys, "asset"], "left")
    joined = joined.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("pnl_weighted", F.col("pnl_points") * F.col("weight"))
    return merged(joined, keys, "pnl_weighted")


def _few(rows: DataFrame, limit: int = 100_000) -> bool:
    return rows.limit(limit + 1).count() <= limit
