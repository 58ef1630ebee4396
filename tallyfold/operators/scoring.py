"""Metrics of one series inside a grouped call: what compute_metrics gives, from arrays.

A search over many combinations needs one row of numbers from each, not its trades and its equity
at every bar, so these never leave the call.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tallyfold.operators.backtest import Series, Taken

#: As in metrics.METRICS, without the p-value.
SCORED = (
    "num_trades", "total_pnl", "win_rate", "avg_win", "avg_loss", "profit_factor", "expectancy",
    "max_drawdown", "max_consec_losses", "sharpe_daily", "sharpe_per_trade", "t_stat",
)
_WHOLE = ("num_trades", "max_consec_losses")
ARROW_SCORED = [(m, pa.int64() if m in _WHOLE else pa.float64()) for m in SCORED]
SPARK_SCORED = T.StructType([T.StructField(m, T.LongType() if m in _WHOLE else T.DoubleType()) for m in SCORED])
NO_TRADES = dict.fromkeys(SCORED) | {"num_trades": 0, "total_pnl": 0.0, "max_drawdown": 0.0, "max_consec_losses": 0}


def _mean(x: np.ndarray) -> float | None:
    return float(x.mean()) if len(x) else None


def _ratio(x: np.ndarray) -> float | None:
    """Mean over sample deviation; None without a spread."""
    spread = float(x.std(ddof=1)) if len(x) > 1 else 0.0
    return float(x.mean()) / spread if spread > 0 else None


def _longest_run(flags: np.ndarray) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def _daily_changes(times: np.ndarray, equity: np.ndarray) -> np.ndarray:
    """Changes of the last equity of each calendar day; days without bars keep the one before."""
    day = times.astype("datetime64[D]").astype(np.int64)
    last = np.flatnonzero(np.append(day[1:] != day[:-1], True))
    return np.diff(equity[last][np.searchsorted(day[last], np.arange(day[0], day[-1] + 1), side="right") - 1])


def series_metrics(times: np.ndarray, series: Series, taken: Taken, periods_per_year: int = 252) -> dict:
    pnl = taken.pnl
    if not len(pnl):
        return dict(NO_TRADES)
    equity = series.equity(taken)
    won, lost = pnl[pnl > 0], pnl[pnl < 0]
    # trades of one exit bar count in the order of their entries, which is the order they are in
    daily, each = _ratio(_daily_changes(times, equity)), _ratio(pnl)
    statistic = None if each is None else each * math.sqrt(len(pnl))
    return {
        "num_trades": len(pnl), "total_pnl": float(pnl.sum()), "win_rate": len(won) / len(pnl), "avg_win": _mean(won), "avg_loss": _mean(lost),
        "profit_factor": float(won.sum() / -lost.sum()) if len(lost) else math.inf if len(won) else None, "expectancy": _mean(pnl),
        "max_drawdown": float((equity - np.maximum.accumulate(equity)).min()), "max_consec_losses": _longest_run(pnl < 0),
        "sharpe_daily": None if daily is None else daily * math.sqrt(periods_per_year), "sharpe_per_trade": statistic, "t_stat": statistic,
    }


def measure(times: np.ndarray, series: Series, taken: Taken) -> pa.StructScalar:
    """series_metrics as one Arrow value."""
    return pa.scalar(series_metrics(times, series, taken), pa.struct(ARROW_SCORED))
