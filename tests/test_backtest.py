import datetime
import math

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import backtest as bt
from tallyfold.operators import compare, portfolio, robustness, walkforward
from tallyfold.operators import strategies as st
from tallyfold.operators.metrics import compute_metrics, longest_losing_run, metrics_table
from test_kernels import WALK, bars

KEYS = ("group", "asset", "tf")
T = list(range(50))


def play(close, signal, high=None, low=None, atr=1.0, ends=None, **rules):
    n = len(close)
    high, low = high or close, low or close
    equity, trades = bt.fold(T[:n], high, low, close, [atr] * n, signal, ends or [False] * n, bt.Execution(**rules))
    return equity, [t for ts in trades for t in ts]


def test_stop_comes_before_target_and_fills_at_its_level():
    equity, trades = play([10, 10, 10], [1, 0, 0], high=[10, 20, 10], low=[10, 1, 10])
    assert [(t[5], t[4]) for t in trades] == [("SL", 8.0)] and equity == [0, -2, -2]


def test_reentry_on_the_bar_of_an_exit():
    _, trades = play([10, 9, 9, 9], [1, 1, 0, 0], low=[10, 7, 9, 9])
    assert [(t[5], t[0], t[1]) for t in trades] == [("SL", 0, 1), ("EOD", 1, 3)]


def test_reversal_and_entry_on_the_last_bar():
    equity, trades = play([10, 11, 12], [1, -1, -1], sl_atr_mult=50, tp_atr_mult=50)
    assert [(t[5], t[2], t[6]) for t in trades] == [("SIGNAL", 1, 1.0), ("EOD", -1, -1.0)] and equity[-1] == 0.0
    _, trades = play([10, 11], [0, 1])
    assert [(t[5], t[7]) for t in trades] == [("EOD", 0)]


def test_session_end_closes_and_the_same_bar_may_open_again():
    _, trades = play([10, 10, 10], [1, 1, 0], ends=[False, True, False], sl_atr_mult=50)
    assert [(t[5], t[0], t[1]) for t in trades] == [("SESSION_END", 0, 1), ("EOD", 1, 2)]


def test_sizes_and_slippage():
    assert play([10, 12], [1, 0], atr=0.5, sizing_mode="vol_scaled", tp_atr_mult=50)[1][0][8] == 2.0
    assert play([10, 12], [1, 0], atr=0.5, sizing_mode="fixed_frac", tp_atr_mult=50)[1][0][8] == 100.0
    assert play([10, 12], [1, 0], atr=0.0, sizing_mode="vol_scaled", sl_atr_mult=9)[1][0][8] == 1.0
    assert play([10, 11], [1, 0], slippage_points=0.25)[1][0][6] == 0.5
    assert play([10, 11], [1, 0], atr=float("nan"))[1] == []


def result(spark, **params):
    s = st.SMACrossoverStrategy(st.SMACrossoverParams(fast=2, slow=5, **params))
    both = bars(spark, WALK).unionByName(bars(spark, WALK[::-1], "B"))
    return bt.Backtester(s).run(both)


def test_trades_add_up_to_equity_and_do_not_overlap(spark):
    r = result(spark)
    total = {x.asset: x.s for x in r.trades.groupBy("asset").agg(F.sum("pnl_points").alias("s")).collect()}
    last = {x.asset: x.e for x in r.equity.groupBy("asset").agg(F.max_by("equity", "timestamp").alias("e")).collect()}
    assert set(total) == {"A", "B"} and all(math.isclose(total[a], last[a], abs_tol=1e-9) for a in total)
    rows = r.trades.orderBy("asset", "exit_time", "entry_time").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.asset != b.asset or b.entry_time >= a.exit_time


def test_losing_run_and_default_metrics(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [("g", "A", "1h", day, day + datetime.timedelta(hours=i), p) for i, p in enumerate((1.0, -1.0, -1.0, 0.0, -1.0))]
    trades = spark.createDataFrame(rows, "`group` string, asset string, tf string, entry_time timestamp_ntz, exit_time timestamp_ntz, pnl_points double")
    assert longest_losing_run(trades, KEYS).first().max_consec_losses == 2
    equity = trades.select(*KEYS, F.col("exit_time").alias("timestamp"), F.lit(0.0).alias("equity"))
    keys = spark.createDataFrame([("g", "A", "1h"), ("g", "none", "1h")], "`group` string, asset string, tf string")
    got = {r.asset: r for r in compute_metrics(trades, equity, all_keys=keys).collect()}
    assert got["A"].win_rate == 0.2 and got["A"].num_trades == 5 and got["A"].sharpe_daily is None
    assert got["A"].profit_factor == pytest.approx(1 / 3) and got["A"].t_stat == got["A"].sharpe_per_trade
    assert got["A"].p_value == pytest.approx(math.erfc(abs(got["A"].t_stat) / math.sqrt(2)))
    assert (got["none"].num_trades, got["none"].total_pnl, got["none"].win_rate) == (0, 0.0, None)
    assert metrics_table(compute_metrics(trades, equity)).count() == 13
    wins = trades.where("pnl_points > 0")
    assert compute_metrics(wins, equity).first().profit_factor == math.inf


def test_runs_end_alike_and_weights_add_up(spark):
    r = result(spark)
    shuffled = robustness.monte_carlo_trades(r.trades, 10)
    ends = robustness.run_endings(shuffled).groupBy("asset").agg(F.max("final").alias("hi"), F.min("final").alias("lo")).collect()
    assert all(math.isclose(e.hi, e.lo, abs_tol=1e-9) for e in ends)
    n = {x.asset: x["count"] for x in r.trades.groupBy("asset").count().collect()}
    for x in robustness.block_bootstrap_trades(r.trades, 3, 4).groupBy("asset", "run").agg(F.count("*").alias("c"), F.max("trade_no").alias("m")).collect():
        assert x.c == x.m == n[x.asset]
    for method in ("equal", "inv_vol", "min_var", "other"):
        weights = [x.weight for x in portfolio.correlation_weights(r.equity, method=method).collect()]
        assert len(weights) == 2 and sum(weights) == pytest.approx(1.0) and min(weights) >= 0


def test_walk_forward_equals_running_each_piece(spark):
    series = bars(spark, WALK)
    grid = {"fast": [2, 3], "slow": [5], "sl_atr_mult": [1.0, 2.0]}
    windows, trades, _ = walkforward.walk_forward(series, grid, st.SMACrossoverStrategy, 2, 0.25)
    rows = series.orderBy("ts").collect()
    for w in windows.collect():
        fold = rows[60 * w.fold : 60 * (w.fold + 1)]
        assert (w.is_start, w.is_end, w.oos_start, w.oos_end) == (fold[0].ts, fold[44].ts, fold[45].ts, fold[59].ts)
        best = None
        for combo in walkforward.combinations(grid):
            part = spark.createDataFrame(fold[:45], series.schema)
            r = bt.Backtester(st.SMACrossoverStrategy(st.SMACrossoverParams(**combo))).run(part)
            m = compute_metrics(r.trades, r.equity, p_value=False).collect()
            score = (m[0].sharpe_daily if m[0].sharpe_daily is not None else m[0].sharpe_per_trade) if m and m[0].num_trades >= 5 else None
            if score is not None and (best is None or score > best[0]):
                best = (score, combo)
        chosen = best[1] if best else {"fast": 20, "slow": 50, "sl_atr_mult": 2.0}
        assert {n: float(w[f"param_{n}"]) for n in grid} == {n: float(v) for n, v in chosen.items()}
        assert (w.is_score is None) == (best is None) and (best is None or w.is_score == pytest.approx(best[0]))
        r = bt.Backtester(st.SMACrossoverStrategy(st.SMACrossoverParams(**chosen))).run(spark.createDataFrame(fold[45:], series.schema))
        assert trades.where(F.col("fold") == w.fold).count() == r.trades.count() == w.oos_trades


def test_registry():
    assert len(compare.STRATEGY_REGISTRY) == 14
    assert compare.slug("EMA Ribbon + RSI") == "ema_ribbon_plus_rsi"
    sma, vwap = compare.STRATEGY_REGISTRY[0], compare.STRATEGY_REGISTRY[10]
    assert compare.make_params_for_group(sma, "b3").session_start == 9 and compare.make_params_for_group(sma, "forex").session_start is None
    assert vwap.b3_overrides == {} and vwap.params_cls().session_end == 18
    assert len(compare.fingerprint(sma)) == 10 != compare.fingerprint(vwap)
