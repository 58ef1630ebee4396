"""Trade and equity metrics per key, all as grouped aggregations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.kernels import KEYS
from tallyfold.functions.scan import DAYS, longest_run, running
from tallyfold.shipping import ship

METRICS = (
    "num_trades", "total_pnl", "win_rate", "avg_win", "avg_loss", "profit_factor", "expectancy",
    "max_drawdown", "max_consec_losses", "sharpe_daily", "sharpe_per_trade", "t_stat", "p_value",
)
EXIT_ORDER = ("exit_time", "entry_time")


@F.pandas_udf(T.DoubleType())
def two_sided(t: pd.Series) -> pd.Series:
    """Two-sided p-value of a normal statistic; there is no built-in error function."""
    return t.map(lambda x: math.erfc(abs(x) / math.sqrt(2.0)) if x == x else None)


def longest_losing_run(trades: DataFrame, keys, order=EXIT_ORDER) -> DataFrame:
    """keys and the longest run of negative results (a zero result ends a run)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = trades.select(*keys, (F.col("pnl_points") < 0).alias("lost"), F.row_number().over(w).alias("i"), *[c for c in order if c not in keys])
    island = F.col("i") - F.row_number().over(Window.partitionBy(*keys, "lost").orderBy("i"))
    runs = numbered.withColumn("island", island).where("lost").groupBy(*keys, "island").count()
    return runs.groupBy(*keys).agg(F.max("count").alias("max_consec_losses"))


def drawdown(equity: DataFrame, keys=KEYS, order: str = "timestamp") -> DataFrame:
    """Equity with `drawdown`, its distance from the peak so far (the first point is the first peak)."""
    peak = F.max("equity").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("drawdown", F.col("equity") - peak)


def daily_changes(equity: DataFrame, keys=KEYS) -> DataFrame:
    """keys, day and daily_return: changes of the last equity of every calendar day, gaps filled."""
    days = equity.groupBy(*keys, F.to_date("timestamp").alias("day")).agg(F.max_by("equity", "timestamp").alias("equity"))
    span = days.groupBy(*keys).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    w = Window.partitionBy(*keys).orderBy("day")
    filled = calendar.join(days, [*keys, "day"], "left").withColumn("equity", F.last("equity", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = filled.withColumn("daily_return", F.col("equity") - F.lag("equity").over(w))
    return change.where("daily_return is not null").select(*keys, "day", "daily_return")


def merged_metrics(trades: DataFrame, keys, order, periods_per_year: int = 252, all_keys: DataFrame | None = None, days: int = DAYS) -> DataFrame:
    """compute_metrics (without p-values) of the joint trades of each key, taken in `order` (whose
    first column is a time), with their running sum as equity. Sums, peaks and losing runs are
    scanned in blocks of so many days, so no task holds a key."""
    held = running(trades.select(*keys, *[c for c in order if c not in keys], "pnl_points"), keys, order, "pnl_points", "equity", days, "peak")
    day = F.to_date(order[0])
    deep = held.groupBy(*keys).agg(F.min(F.col("equity") - F.col("peak")).alias("max_drawdown"))
    last = held.groupBy(*keys, day.alias("day")).agg(F.max_by("equity", F.struct(*order)).alias("equity")).withColumn("timestamp", F.col("day").cast("timestamp_ntz"))
    runs = longest_run(trades, keys, order, F.col("pnl_points") < 0, "max_consec_losses", days)
    return _finished(trades, keys, (runs, deep, _daily_sharpe(last, keys, periods_per_year)), all_keys, False)


def _daily_sharpe(equity: DataFrame, keys, periods_per_year: int) -> DataFrame:
    daily = daily_changes(equity, keys).groupBy(*keys).agg(F.avg("daily_return").alias("_m"), F.stddev_samp("daily_return").alias("_s"))
    return daily.select(*keys, F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * math.sqrt(periods_per_year)).alias("sharpe_daily"))


def compute_metrics(trades: DataFrame, equity: DataFrame, keys=KEYS, periods_per_year: int = 252, all_keys: DataFrame | None = None, p_value: bool = True) -> DataFrame:
    """One row of METRICS per key; keys of all_keys without trades get the defaults."""
    depth = drawdown(equity, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    return _finished(trades, keys, (longest_losing_run(trades, keys), depth, _daily_sharpe(equity, keys, periods_per_year)), all_keys, p_value)


def _finished(trades: DataFrame, keys, parts, all_keys: DataFrame | None, p_value: bool) -> DataFrame:
    pnl = F.col("pnl_points")
    won, lost = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, pnl))
    base = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_trades"), F.sum(pnl).alias("total_pnl"), F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(pnl > 0, pnl)).alias("avg_win"), F.avg(F.when(pnl < 0, pnl)).alias("avg_loss"),
        F.when(lost < 0, F.coalesce(won, F.lit(0.0)) / F.abs(lost)).when(won > 0, F.lit(float("inf"))).alias("profit_factor"),
        F.avg(pnl).alias("expectancy"), F.stddev_samp(pnl).alias("_sd"),
    )
    statistic = F.when((F.col("num_trades") > 1) & (F.col("_sd") > 0), F.col("expectancy") / (F.col("_sd") / F.sqrt("num_trades")))
    out = base.withColumn("t_stat", statistic).withColumn("sharpe_per_trade", F.col("t_stat"))
    for part in parts:
        out = out.join(part, list(keys), "left")
    if all_keys is not None:
        out = all_keys.select(*keys).distinct().join(out, list(keys), "left")
    zero = {"num_trades": 0, "total_pnl": 0.0, "max_consec_losses": 0, "max_drawdown": 0.0}
    out = out.fillna(zero, list(zero))
    names = list(METRICS) if p_value else [m for m in METRICS if m != "p_value"]
    if p_value:
        ship(trades.sparkSession)
        out = out.withColumn("p_value", two_sided("t_stat"))
    return out.select(*keys, *names)


def metrics_table(metrics: DataFrame, keys=KEYS) -> DataFrame:
    """Long form: keys, metric and value, with the metric's place."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(METRICS) if m in metrics.columns])
    return metrics.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def metrics_comparison(metrics: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Metrics as rows, the values of `column` (such as tf) as columns."""
    long = metrics_table(metrics, (*keys, column))
    return long.groupBy(*keys, "place", "metric").pivot(column).agg(F.first("value"))


def subperiods(trades: DataFrame, keys=KEYS) -> DataFrame:
    """Metrics by year of exit; equity starts at 0 in each year."""
    by = [*keys, "period"]
    dated = trades.withColumn("period", F.year("exit_time"))
    w = Window.partitionBy(*by).orderBy(*EXIT_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    equity = dated.select(*by, F.col("exit_time").alias("timestamp"), F.sum("pnl_points").over(w).alias("equity"))
    return compute_metrics(dated, equity, by, p_value=False)
