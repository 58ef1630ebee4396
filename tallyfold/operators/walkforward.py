"""Walk-forward optimisation in two phases: folds by row number, combinations tried on their first parts.

Combinations that differ only in stop and target share one computation of signals, so the grid is
split into signal parameters and execution parameters.

1. Search. Signals of every signal combination are computed on the first parts, each of which is a
   series of its own. One grouped call per (series, fold) gets the bars once and of each signal
   combination only the bars that have a signal; it plays all combinations on them and returns a row
   of metrics for each. The score picks the best.
2. Confirmation. Only the chosen combination of a fold is computed on its second part, where
   indicators start cold, and only its trades and equity leave the workers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from functools import reduce
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.kernels import KEYS
from tallyfold.operators.backtest import Execution, Series, equity_of, numbers, run, session_ends, signals_in, trades_of
from tallyfold.operators.metrics import EXIT_ORDER, merged_metrics
from tallyfold.operators.scoring import ARROW_SCORED, SPARK_SCORED, measure, series_metrics
from tallyfold.shipping import ship
from tallyfold.staging import staged

EXECUTION = ("sl_atr_mult", "tp_atr_mult")
LEAST_ROWS = 50


class WFOResult(NamedTuple):
    """windows has a row per series and fold; trades and equity are those of the second parts."""

    windows: DataFrame
    trades: DataFrame
    equity: DataFrame

    @property
    def best_params(self) -> DataFrame:
        return pick_best_params(self.windows, [c for c in self.windows.columns if c in KEYS])

    @property
    def mean_degradation(self) -> DataFrame:
        """Mean ratio of second to first part of each series."""
        return self.windows.groupBy(*[c for c in self.windows.columns if c in KEYS]).agg(F.avg("degradation_ratio").alias("degradation_ratio"))


def default_score() -> Column:
    """Daily Sharpe ratio, else the one per trade; null with fewer than five trades."""
    return F.when(F.col("num_trades") >= 5, F.coalesce("sharpe_daily", "sharpe_per_trade"))


def split_folds(bars: DataFrame, n_splits: int, oos_ratio: float, keys=KEYS) -> DataFrame:
    """Adds fold and segment (is or oos). Folds have equal row counts, the last takes the rest;
    short folds are left out."""
    w = Window.partitionBy(*keys)
    numbered = bars.withColumns({"_i": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(w)})
    size = F.floor(F.col("_n") / n_splits)
    numbered = numbered.withColumn("fold", F.least(F.floor(F.col("_i") / F.greatest(size, F.lit(1))), F.lit(n_splits - 1)).cast("int"))
    inside = Window.partitionBy(*keys, "fold")
    numbered = numbered.withColumns({"_k": F.row_number().over(inside.orderBy("ts")) - 1, "_m": F.count(F.lit(1)).over(inside)})
    split = F.greatest(F.lit(1), F.floor(F.col("_m") * (1.0 - oos_ratio)))
    return numbered.where((F.col("_m") >= LEAST_ROWS) & (split < F.col("_m"))).withColumn("segment", F.when(F.col("_k") < split, "is").otherwise("oos")).drop("_i", "_n", "_k", "_m")


def combinations(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


class Grid:
    """Combinations (the class defaults stand behind them) and the signal parameters they share."""

    def __init__(self, strategy_cls, grid: dict[str, list]):
        unknown = sorted(set(grid) - {f.name for f in fields(strategy_cls.params_class)})
        if unknown:
            raise ValueError(f"{strategy_cls.__name__} has no parameter {', '.join(unknown)}")
        self.strategy_cls, self.tried = strategy_cls, combinations(grid)
        self.params = [strategy_cls.params_class(**c) for c in (*self.tried, {})]
        shapes = [tuple((f.name, getattr(p, f.name)) for f in fields(p) if f.name not in EXECUTION) for p in self.params]
        self.distinct = list(dict.fromkeys(shapes))
        self.shape = [self.distinct.index(s) for s in shapes]

    def members(self, shape: int) -> list[int]:
        return [i for i, s in enumerate(self.shape) if s == shape]

    def signals(self, shape: int, bars: DataFrame, keys) -> DataFrame:
        return self.strategy_cls(self.params[self.shape.index(shape)], keys).signals(bars)


def search(bars: DataFrame, grid: Grid, keys) -> DataFrame:
    """keys, combo and metrics of every combination tried over every series of bars."""
    keys = tuple(keys)
    none = F.lit(None).cast("double")
    parts = [bars.select(*keys, "ts", F.lit(-1).alias("shape"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")], none.alias("atr"), F.lit(0).alias("signal"))]
    tried = set(grid.shape[:-1])
    for shape in sorted(tried):
        fired = grid.signals(shape, bars, keys).where("signal <> 0")
        parts.append(fired.select(*keys, "ts", F.lit(shape).alias("shape"), *[none.alias(c) for c in ("high", "low", "close")], F.col("atr").cast("double").alias("atr"), "signal"))
    rules, members, count = [Execution.of(p) for p in grid.params], {s: grid.members(s) for s in tried}, len(grid.tried)
    schema = T.StructType([*[bars.schema[c] for c in keys], T.StructField("combo", T.IntegerType()), *SPARK_SCORED.fields])

    def play(table: pa.Table) -> pa.Table:
        shape = table.column("shape").to_numpy()
        held = table.filter(pa.array(shape < 0)).sort_by("ts")
        times = held.column("ts").to_numpy().astype("datetime64[us]")
        high, low, close = numbers(held, "high", "low", "close")
        rows = []
        for s, combos in members.items():
            fired = table.filter(pa.array(shape == s))
            place = np.searchsorted(times, fired.column("ts").to_numpy().astype("datetime64[us]"))
            atr, signal = np.full(len(times), np.nan), np.zeros(len(times), np.int64)
            atr[place], signal[place] = numbers(fired, "atr")[0], signals_in(fired)
            series = Series(high, low, close, atr, signal, session_ends(times, rules[combos[0]].session_start, rules[combos[0]].session_end))
            rows += [{"combo": i} | series_metrics(times, series, series.play(rules[i])) for i in combos if i < count]
        own = pa.Table.from_pylist(rows, schema=pa.schema([("combo", pa.int32()), *ARROW_SCORED]))
        heads = {c: pa.array([table.column(c)[0].as_py()] * len(rows), table.schema.field(c).type) for c in keys}
        return pa.table(heads | {c: own.column(c) for c in own.column_names})

    ship(bars.sparkSession)
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).applyInArrow(play, schema)


def walk_forward(bars: DataFrame, grid: dict[str, list], strategy_cls, n_splits: int = 5, oos_ratio: float = 0.25, score: Callable[[], Column] = default_score, keys=KEYS) -> WFOResult:
    """(windows, trades, equity): the best combination of each fold's first part, run on its second.

    The first of equally good combinations wins; without any finite score the class defaults run.
    Out-of-sample equity of later folds starts where the earlier ones ended. Names that the
    parameters of the strategy don't have raise at once."""
    keys, plan = tuple(keys), Grid(strategy_cls, grid)
    spark, by = bars.sparkSession, (*keys, "fold")
    # read by every computation of signals
    cut = staged(split_folds(bars, n_splits, oos_ratio, keys), "cut")
    segments = cut.groupBy(*by, "segment").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    ends = segments.groupBy(*by).agg(*[F.max(F.when(F.col("segment") == s, F.col(c))).alias(f"{s}_{c}") for s in ("is", "oos") for c in ("start", "end")])
    results = search(cut.where("segment = 'is'").drop("segment"), plan, by)
    scored = results.select(*by, "combo", score().alias("is_score")).where("is_score is not null and not isnan(is_score)")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("is_score"), "combo"))
    chosen = scored.withColumn("r", first).where("r = 1").drop("r")
    defaults = len(plan.tried)
    folds = staged(ends.join(chosen, list(by), "left").withColumn("combo", F.coalesce("combo", F.lit(defaults))), "folds")
    second, parts = cut.where("segment = 'oos'").drop("segment"), []
    # as many rows at most as there are combinations
    won = {r["combo"] for r in folds.select("combo").distinct().collect()}
    for shape in sorted({plan.shape[i] for i in won}) or [plan.shape[defaults]]:
        mine = second.join(folds.where(F.col("combo").isin(plan.members(shape))).select(*by, F.col("combo").alias("rule")), list(by))
        parts.append(plan.signals(shape, mine, by).select(*by, "ts", "high", "low", "close", "atr", "signal", "rule"))
    result = staged(run(reduce(DataFrame.unionByName, parts), [Execution.of(p) for p in plan.params], by, measure, SPARK_SCORED), "confirmed")
    trades, equity = trades_of(result, by), equity_of(result, by)
    measured = result.where("measured is not null").select(*by, "measured.*")
    values = [(i, *[str(getattr(p, n)) for n in grid]) for i, p in enumerate(plan.params)]
    params = spark.createDataFrame(values, ", ".join(["combo int", *[f"param_{n} string" for n in grid]]))
    # the number of combinations is fixed by the grid, not by the data
    windows = folds.join(measured, list(by), "left").fillna({"num_trades": 0, "total_pnl": 0.0}).join(F.broadcast(params), "combo").select(
        *by, "is_start", "is_end", "oos_start", "oos_end", "is_score", F.col("total_pnl").alias("oos_pnl"), F.col("sharpe_daily").alias("oos_sharpe"),
        F.col("profit_factor").alias("oos_profit_factor"), F.col("win_rate").alias("oos_win_rate"), F.col("num_trades").alias("oos_trades"),
        F.when(F.col("is_score") > 0, F.col("sharpe_daily") / F.col("is_score")).alias("degradation_ratio"), *[f"param_{n}" for n in grid],
    )
    return WFOResult(windows, trades, stitched(equity, keys))


def stitched(equity: DataFrame, keys=KEYS) -> DataFrame:
    """Each fold's equity raised by the final equity of the folds before it."""
    finals = equity.groupBy(*keys, "fold").agg(F.max_by("equity", "timestamp").alias("final"))
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    offsets = finals.select(*keys, "fold", F.coalesce(F.sum("final").over(before), F.lit(0.0)).alias("offset"))
    return equity.join(offsets, [*keys, "fold"]).withColumn("equity", F.col("equity") + F.col("offset")).drop("offset")


def pick_best_params(windows: DataFrame, keys=KEYS) -> DataFrame:
    """The parameters chosen most often over the folds; of equals the earliest."""
    names = [c for c in windows.columns if c.startswith("param_")]
    counted = windows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("folds"), F.min("fold").alias("first_fold"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("folds"), "first_fold"))
    return counted.withColumn("r", best).where("r = 1").drop("r")


def best_timeframe(windows: DataFrame, keys=("group", "asset")) -> DataFrame:
    """The timeframe with the highest out-of-sample ratio of each key; ties go to the first name."""
    means = windows.where("oos_sharpe is not null").groupBy(*keys, "tf").agg(F.avg("oos_sharpe").alias("oos_sharpe"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("oos_sharpe"), "tf"))
    return means.withColumn("r", first).where("r = 1").drop("r")


def combined_windows(windows: DataFrame, trades: DataFrame, keys=("group", "tf")) -> DataFrame:
    """Per fold over all assets: metrics of the joint trades, the mean degradation, and the
    boundaries and parameters of the first asset."""
    by = [*keys, "fold"]
    joint = merged_metrics(trades, by, (*EXIT_ORDER[:1], "asset", *EXIT_ORDER[1:]))
    names = [c for c in windows.columns if c.startswith("param_")]
    lead = windows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("asset"))).where("r = 1").select(*by, "is_start", "is_end", "oos_start", "oos_end", *names)
    decay = windows.groupBy(*by).agg(F.avg("degradation_ratio").alias("degradation_ratio"))
    return joint.join(lead, by, "left").join(decay, by, "left")
