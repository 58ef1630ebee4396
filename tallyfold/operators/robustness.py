"""Monte-Carlo and bootstrap runs, sensitivity sweeps, synthetic series.

Runs stay long: one row per run and trade. Random order comes from a hash of (seed, run, trade), so
runs are repeatable and SQL can reproduce them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.kernels import KEYS
from tallyfold.functions.scan import earliest
from tallyfold.operators.backtest import Execution, equity_of, run, trades_of
from tallyfold.operators.metrics import EXIT_ORDER, compute_metrics, merged_metrics
from tallyfold.shipping import ship
from tallyfold.staging import staged


def _numbered(trades: DataFrame, keys) -> DataFrame:
    w = Window.partitionBy(*keys)
    return trades.select(*keys, "pnl_points", (F.row_number().over(w.orderBy(*EXIT_ORDER)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


def head_trades(trades: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """The n earliest trades of each key, by exit; no key is sorted as a whole."""
    return earliest(trades, keys, EXIT_ORDER, n)


def draw(*parts: Column) -> Column:
    """A 32-hex-digit draw from the given values."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _runs(df: DataFrame, n_runs: int) -> DataFrame:
    return df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))


def monte_carlo_trades(trades: DataFrame, n_runs: int = 1000, seed: int = 42, keys=KEYS) -> DataFrame:
    """keys, run, trade_no and equity: every run adds up the trades in another order."""
    rows = _runs(_numbered(trades, keys), n_runs)
    order = Window.partitionBy(*keys, "run").orderBy(draw(F.lit(seed), F.col("run"), F.col("i")), "i")
    return rows.select(*keys, "run", F.row_number().over(order).alias("trade_no"), F.sum("pnl_points").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("equity"))


def block_bootstrap_trades(trades: DataFrame, block_size: int | None = None, n_runs: int = 1000, seed: int = 42, keys=KEYS) -> DataFrame:
    """As monte_carlo_trades, with runs made of circular blocks that start at random trades."""
    rows = _numbered(trades, keys)
    size = F.lit(block_size) if block_size else F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("int")
    heads = rows.groupBy(*keys).agg(F.max("n").alias("n")).withColumn("b", size)
    blocks = _runs(heads, n_runs).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("b")).cast("int") - 1)))
    start = F.conv(F.substring(draw(F.lit(seed), F.col("run"), F.col("block")), 1, 8), 16, 10).cast("long") % F.col("n")
    steps = blocks.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    steps = steps.withColumn("trade_no", F.col("block") * F.col("b") + F.col("k") + 1).where("trade_no <= n")
    picked = steps.withColumn("i", (F.col("start") + F.col("k")) % F.col("n")).join(rows.drop("n"), [*keys, "i"])
    w = Window.partitionBy(*keys, "run").orderBy("trade_no").rowsBetween(Window.unboundedPreceding, 0)
    return picked.select(*keys, "run", "trade_no", F.sum("pnl_points").over(w).alias("equity"))


def run_endings(runs: DataFrame, keys=KEYS) -> DataFrame:
    """keys, run, final equity and deepest drawdown of each run."""
    w = Window.partitionBy(*keys, "run").orderBy("trade_no").rowsBetween(Window.unboundedPreceding, 0)
    deep = runs.withColumn("fall", F.max("equity").over(w) - F.col("equity"))
    return deep.groupBy(*keys, "run").agg(F.max_by("equity", "trade_no").alias("final"), F.max("fall").alias("fall"))


def quantile(column: str, share: float, accuracy: int | None = None) -> Column:
    """Exact (interpolated) quantile, which holds all values of a group; or, with an accuracy, a
    value whose rank is off by at most a 1/accuracy share of the group, from a sketch of bounded
    size that combines before the exchange."""
    return F.percentile(column, F.lit(share)) if accuracy is None else F.percentile_approx(column, share, accuracy)


def monte_carlo_summary(runs: DataFrame, keys=KEYS, accuracy: int | None = None) -> DataFrame:
    ends = run_endings(runs, keys)
    return ends.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("final").alias("mean_final"), *[quantile("final", p, accuracy).alias(n) for p, n in ((0.5, "median_final"), (0.05, "p05_final"), (0.95, "p95_final"))],
        (-F.avg("fall")).alias("mean_max_dd"), (-quantile("fall", 0.95, accuracy)).alias("p95_max_dd"), F.avg((F.col("final") > 0).cast("double")).alias("prob_profitable"),
    )


def quantile_cone(runs: DataFrame, keys=KEYS, accuracy: int | None = None) -> DataFrame:
    """Quantiles of equity over all runs, per trade number."""
    return runs.groupBy(*keys, "trade_no").agg(*[quantile("equity", p, accuracy).alias(f"q{round(p * 100):02d}") for p in (0.05, 0.5, 0.95)])


def parameter_sensitivity(bars: DataFrame, base, variations: dict[str, list], strategy_cls, keys=KEYS, joint: tuple[str, ...] | None = None) -> DataFrame:
    """Metrics with one parameter changed at a time: keys, param, value and the metrics. With
    `joint`, over the merged trades of all series of those keys."""
    from dataclasses import replace

    parts = []
    for name, values in variations.items():
        for value in values:
            params = replace(base, **{name: value})
            result = run(strategy_cls(params, keys).signals(bars), Execution.of(params), keys)
            parts.append(result.select(*keys, F.lit(name).alias("param"), F.lit(float(value)).alias("value"), "ts", "equity", "trades"))
    # trades, equity and keys are read apart; the pass over the bars is made once
    result = staged(reduce(DataFrame.unionByName, parts), "sensitivity")
    by = (*keys, "param", "value")
    trades, equity = trades_of(result, by), equity_of(result, by)
    if joint is None:
        return compute_metrics(trades, equity, by, all_keys=result, p_value=False)
    by = (*joint, "param", "value")
    return merged_metrics(trades, by, [c for c in (*EXIT_ORDER, *keys) if c not in by], all_keys=result)


def synthetic_assets(bars: DataFrame, copies: int, n_bars: int, first: int = 5, block: int = 1, seed: int = 42, keys=KEYS) -> DataFrame:
    """Series made of another one's own bar-to-bar changes, drawn at random in blocks. The first bars
    are kept; values are floored at a ten-thousandth of the one before, and high and low are widened
    to hold open and close. Adds `copy`."""
    prices = ["open", "high", "low", "close"]
    base = _runs(bars.select(*keys, "ts", *prices), copies).withColumnRenamed("run", "copy")

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        values = np.column_stack([table.column(c).to_numpy().astype(float) for c in prices])
        times = table.column("ts").to_numpy()
        rng = np.random.default_rng([seed, table.column("copy")[0].as_py()])
        moves = np.diff(values, axis=0)
        out = list(values[: min(first, n_bars)])
        while len(out) < n_bars and len(moves):
            at = int(rng.integers(0, max(1, len(moves) - block + 1)))
            for move in moves[at : at + block]:
                if len(out) < n_bars:
                    nxt = np.maximum(out[-1] + move, out[-1] * 1e-4)
                    nxt[1], nxt[2] = max(nxt[1], nxt[0], nxt[3]), min(nxt[2], nxt[0], nxt[3])
                    out.append(nxt)
        step = times[1] - times[0] if len(times) > 1 else np.timedelta64(1, "h")
        made = np.array(out)
        heads = {c: pa.array([table.column(c)[0].as_py()] * len(made), table.schema.field(c).type) for c in (*keys, "copy")}
        return pa.table({**heads, "ts": pa.array(times[0] + step * np.arange(len(made)), pa.timestamp("us")), **{c: made[:, i] for i, c in enumerate(prices)}})

    ship(bars.sparkSession)
    head = ", ".join(f"{'`' + c + '`'} string" for c in keys)
    return base.groupBy(*keys, "copy").applyInArrow(make, f"{head}, copy int, ts timestamp_ntz, open double, high double, low double, close double")
