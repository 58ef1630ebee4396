"""Public names in one place."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from tallyfold.functions.kernels import windowed_bars as iter_windowed_bars
from tallyfold.operators.backtest import TRADE as Trade
from tallyfold.operators.backtest import Backtester, BacktestResult
from tallyfold.operators.compare import (
    STRATEGY_REGISTRY, StrategyRegistration, daily_returns_from_equity, equity_overlay, group_aggregated_metrics, leaderboard, make_params_for_group,
    metric_distribution, optimised_params, pivot_metric, return_correlation, run_all_strategies, run_backtest_grid, run_backtests_with_params,
    variant_metrics,
)
from tallyfold.operators.metrics import compute_metrics, merged_metrics, metrics_comparison, metrics_table
from tallyfold.operators.metrics import subperiods as subperiod_analysis
from tallyfold.operators.portfolio import correlation_weights, weighted_portfolio
from tallyfold.operators.portfolio import merged as build_portfolio
from tallyfold.operators.robustness import block_bootstrap_trades, head_trades, monte_carlo_summary, monte_carlo_trades, parameter_sensitivity, quantile_cone
from tallyfold.operators.robustness import synthetic_assets as generate_synthetic_asset
from tallyfold.operators.strategies import (
    BBSqueezeParams, BBSqueezeStrategy, DualThrustParams, DualThrustStrategy, EMARibbonParams, EMARibbonStrategy, FFTCycleFilterStrategy,
    MACDHistogramParams, MACDHistogramStrategy, RSIMeanReversionParams, RSIMeanReversionStrategy, SMACrossoverStrategy, VWAPReversionParams, VWAPReversionStrategy,
)
from tallyfold.operators.strategies import DonchianParams as DonchianBreakoutParams
from tallyfold.operators.strategies import DonchianStrategy as DonchianBreakoutStrategy
from tallyfold.operators.strategies import FFTCycleParams as FFTCycleFilterParams
from tallyfold.operators.strategies import HMMRegimeParams as HMMRegimeFilterParams
from tallyfold.operators.strategies import HMMRegimeStrategy as HMMRegimeFilterStrategy
from tallyfold.operators.strategies import HurstParams as HurstRegimeSwitcherParams
from tallyfold.operators.strategies import HurstRegimeStrategy as HurstRegimeSwitcherStrategy
from tallyfold.operators.strategies import KeltnerParams as KeltnerReversionParams
from tallyfold.operators.strategies import KeltnerReversionStrategy
from tallyfold.operators.strategies import LRChannelParams as LinearRegressionChannelParams
from tallyfold.operators.strategies import LRChannelStrategy as LinearRegressionChannelStrategy
from tallyfold.operators.strategies import SMACrossoverParams as StrategyParams
from tallyfold.operators.strategies import StochasticParams as StochasticDivergenceParams
from tallyfold.operators.strategies import StochasticStrategy as StochasticDivergenceStrategy
from tallyfold.operators.walkforward import WFOResult, best_timeframe, combined_windows, default_score, pick_best_params, walk_forward
from tallyfold.sources.bars import DatasetMeta, GridSpec, LazyDataset, build_lazy_grid, discover_datasets, folder_bars, grid_bars, load_all, load_all_lazy, load_csv, resample_ohlc, reshape_grid_results, save_csv, ticks_to_bars, ticks_to_frames
from tallyfold.sources.cache import ResultCache
from tallyfold.streaming.backtest import stream_backtest
from tallyfold.streaming.bars import stream_bars

#: A grid cell is a row of keys; walking forward over a grid is walking forward over a keyed table.
run_wfo_grid = walk_forward


def cpu_count() -> int:
    return os.cpu_count() or 1


def resolve_n_jobs(n_jobs: int | None) -> int:
    """Worker count from None or -1 (all), -k (all but k - 1) or a positive number."""
    if n_jobs == 0:
        raise ValueError("n_jobs must not be 0")
    if n_jobs is None:
        return cpu_count()
    return n_jobs if n_jobs > 0 else max(1, cpu_count() + 1 + n_jobs)


def parallel_map(spark: SparkSession, f: Callable, items: Iterable) -> list:
    """f over a bounded driver-side list, one task per item, in order."""
    given = list(items)
    return spark.sparkContext.parallelize(given, len(given)).map(f).collect() if given else []


__all__ = [name for name in dir() if not name.startswith("_") and name not in ("annotations", "os", "Callable", "Iterable", "SparkSession")]
