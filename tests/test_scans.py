"""Block scans, Gram sums and the event-jump back-test against plain restatements."""

import datetime
import math
import random
from dataclasses import fields

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import gram, recursion, scan
from tallyfold.operators import backtest as bt
from tallyfold.operators import compare, portfolio, robustness, walkforward
from tallyfold.operators import strategies as st
from tallyfold.operators.metrics import METRICS, compute_metrics, merged_metrics
from tallyfold.operators.scoring import SCORED, series_metrics
from test_kernels import START, WALK, bars, frame

KEYS = ("group", "asset", "tf")
DAY = datetime.timedelta(days=1)


def bar_by_bar(times, high, low, close, atr, signal, ends, rules):
    """The rules one bar at a time: (equity, trades)."""
    equity, trades, held, running = [], [], None, 0.0

    def leave(i, reason, price):
        side, size, entry, bar, _, _ = held
        gain = (price - entry) * side * size - 2.0 * rules.slippage_points * size
        trades.append((times[bar], times[i], side, entry, price, reason, gain, i - bar, size))
        return running + gain

    for i, price in enumerate(close):
        if held is not None:
            side, _, _, _, stop, target = held
            stopped, reached = (low[i] <= stop, high[i] >= target) if side > 0 else (high[i] >= stop, low[i] <= target)
            out = ("SL", stop) if stopped else ("TP", target) if reached else ("SIGNAL", price) if signal[i] == -side else ("SESSION_END", price) if ends[i] else None
            if out:
                running = leave(i, *out)
                held = None
        if held is None and signal[i] != 0 and not math.isnan(atr[i]):
            side, size = int(signal[i]), 1.0
            if atr[i] > 0 and rules.sizing_mode == "vol_scaled":
                size = 1.0 / atr[i]
            elif atr[i] > 0 and rules.sizing_mode == "fixed_frac":
                size = (rules.initial_capital + running) * rules.risk_fraction / (rules.sl_atr_mult * atr[i])
            held = (side, size, price, i, price - side * atr[i] * rules.sl_atr_mult, price + side * atr[i] * rules.tp_atr_mult)
        equity.append(running)
    if held is not None:
        running = leave(len(close) - 1, "EOD", close[-1])
        equity[-1] = running
    return equity, trades


def drawn_series(rng, n):
    close = 100 + np.cumsum(rng.normal(size=n)).round(1)
    high, low = close + rng.random(n).round(1) * 2, close - rng.random(n).round(1) * 2
    high[rng.random(n) < 0.02] = np.nan
    atr = np.where(rng.random(n) < 0.1, np.nan, np.where(rng.random(n) < 0.1, 0.0, rng.random(n) * 2))
    return high, low, close, atr, rng.choice([-1, 0, 1], size=n, p=[0.2, 0.6, 0.2]), rng.random(n) < 0.1


def test_event_jumps_equal_bar_by_bar():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, *rng.integers(4, 300, 60)]:
        series = drawn_series(rng, int(n))
        for mode in ("unit", "vol_scaled", "fixed_frac"):
            rules = bt.Execution(float(rng.choice([0.5, 2, 50])), float(rng.choice([1, 3, 100])), sizing_mode=mode, slippage_points=0.1)
            equity, trades = bt.fold(list(range(n)), *series, rules)
            want_equity, want = bar_by_bar(list(range(n)), *series, rules)
            got = [t for ts in trades for t in ts]
            assert [t[:3] + (t[5], t[7]) for t in got] == [t[:3] + (t[5], t[7]) for t in want]
            np.testing.assert_allclose([[t[3], t[4], t[6], t[8]] for t in got], [[t[3], t[4], t[6], t[8]] for t in want], atol=1e-9)
            np.testing.assert_allclose(equity, want_equity, atol=1e-9)


def test_all_strategies_trade_alike_bar_by_bar(spark):
    both = bars(spark, WALK * 2, wide=0.3)
    for number, cls in st.ALL.items():
        params = cls.params_class(**({"fast": 2, "slow": 5} if number == "01" else {}))
        signals = cls(params).signals(both)
        rows = signals.orderBy("ts").select("ts", "high", "low", "close", "atr", "signal").toPandas()
        rules = bt.Execution.of(params)
        times = rows["ts"].to_numpy().astype("datetime64[us]")
        _, want = bar_by_bar(rows["ts"].tolist(), *[rows[c].to_numpy(float) for c in ("high", "low", "close", "atr")], rows["signal"].to_numpy(), bt.session_ends(times, rules.session_start, rules.session_end), rules)
        got = bt.trades_of(bt.run(signals, rules)).orderBy("exit_time", "entry_time").collect()
        assert [(r.entry_time, r.exit_time, r.direction, r.reason, r.bars_held) for r in got] == [(t[0], t[1], t[2], t[5], t[7]) for t in want], number
        assert [r.pnl_points for r in got] == pytest.approx([t[6] for t in want])


def test_metrics_inside_a_call_equal_those_of_the_tables(spark):
    signals = st.SMACrossoverStrategy(st.SMACrossoverParams(fast=2, slow=5)).signals(bars(spark, WALK).unionByName(bars(spark, [5.0] * 60, "still")))
    result = bt.run(signals, bt.Execution())
    want = {r.asset: r for r in compute_metrics(bt.trades_of(result), bt.equity_of(result), all_keys=result).collect()}
    for asset, rows in frame(signals).groupby("asset"):
        times = rows["ts"].to_numpy().astype("datetime64[us]")
        series = bt.Series(*[rows[c].to_numpy(float) for c in ("high", "low", "close", "atr")], rows["signal"].to_numpy(), np.zeros(len(rows), bool))
        got = series_metrics(times, series, series.play(bt.Execution()))
        for m in SCORED:
            if not (asset == "still" and m == "max_drawdown"):
                assert got[m] == (want[asset][m] if want[asset][m] is None else pytest.approx(want[asset][m])), (asset, m)
    assert set(SCORED) == set(METRICS) - {"p_value"}


def test_averages_in_blocks_equal_those_of_the_whole_series(spark):
    rng = random.Random(3)
    closes = [c if rng.random() > 0.2 else None for c in WALK * 4]
    closes[:40] = [None] * 40
    rows = [("g", a, "1h", START + datetime.timedelta(hours=3 * i), c) for a in ("A", "B") for i, c in enumerate(closes if a == "A" else [None] * 9)]
    df = spark.createDataFrame(rows, "`group` string, asset string, tf string, ts timestamp_ntz, close double")
    specs = [recursion.Ewm("slow", "close", 0.05, 20), recursion.Ewm("quick", "close", 0.5, 1), recursion.Derived("apart", lambda f: f["quick"] - f["slow"], rowwise=True), recursion.Ewm("line", "apart", 0.2, 9)]
    want = frame(recursion.with_recursions(df, specs))
    for days in (1, 7, 400):
        got = frame(recursion.with_recursions(df, specs, days=days))
        for s in specs:
            np.testing.assert_allclose(got[s.out], want[s.out], rtol=1e-9, atol=1e-12)
    assert df.select(scan.block_of("ts", 1)).distinct().count() >= 8


def test_session_setting_spreads_the_averages_of_strategies(spark):
    both = bars(spark, WALK).unionByName(bars(spark, WALK[::-1], "B"))
    want = {n: frame(st.ALL[n]().signals(both)) for n in ("02", "04", "06", "07", "08")}
    spark.conf.set(recursion.SCAN_DAYS, "1")
    try:
        for n, w in want.items():
            pd.testing.assert_frame_equal(frame(st.ALL[n]().signals(both)), w, check_exact=False, rtol=1e-9)
    finally:
        spark.conf.unset(recursion.SCAN_DAYS)


def hot_trades(spark):
    """One key with nearly all trades, ties of exit time, and days without any."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        key = "hot" if i % 30 else f"k{i % 4}"
        when = START + DAY * rng.choice([0, 1, 1, 5, 40, 41, 90, 200]) + datetime.timedelta(hours=rng.randrange(24))
        rows.append((key, "1h", f"a{rng.randrange(5)}", when - datetime.timedelta(minutes=i), when, rng.choice([-2.0, -1.0, -1.0, 0.0, 1.5, 3.0])))
    return spark.createDataFrame(rows, "`group` string, tf string, asset string, entry_time timestamp_ntz, exit_time timestamp_ntz, pnl_points double").repartition(3)


def test_merged_equity_and_metrics_of_a_hot_group(spark):
    trades, keys = hot_trades(spark), ["group", "tf"]
    order = ["exit_time", "asset", "entry_time"]
    rows = trades.toPandas().sort_values([*keys, *order]).reset_index(drop=True)
    rows["equity"] = rows.groupby("group")["pnl_points"].cumsum()
    for days in (1, 30, 1000):
        got = portfolio.merged(trades, days=days).toPandas().sort_values([*keys, *order]).reset_index(drop=True)
        np.testing.assert_allclose(got["equity"], rows["equity"])
        found = {r.group: r for r in merged_metrics(trades, keys, order, days=days).collect()}
        for name, part in rows.groupby("group"):
            run = longest = 0
            for p in part["pnl_points"]:
                run = run + 1 if p < 0 else 0
                longest = max(longest, run)
            fall = (part["equity"] - part["equity"].cummax()).min()
            daily = part.groupby(part["exit_time"].dt.floor("D"))["equity"].last().resample("D").last().ffill().diff().dropna()
            sharpe = daily.mean() / daily.std() * math.sqrt(252) if len(daily) > 1 and daily.std() > 0 else None
            r = found[name]
            assert (r.num_trades, r.max_consec_losses) == (len(part), longest)
            assert (r.total_pnl, r.max_drawdown) == (pytest.approx(part["pnl_points"].sum()), pytest.approx(fall))
            assert r.sharpe_daily == (None if sharpe is None else pytest.approx(sharpe))


def test_no_window_runs_over_a_whole_group(spark):
    trades = hot_trades(spark)
    plan = portfolio.merged(trades)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line for line in windows)


def test_earliest_rows_of_each_key(spark):
    trades = hot_trades(spark)
    rows = trades.toPandas().sort_values(["exit_time", "entry_time"])
    for n in (1, 7, 5000):
        want = rows.groupby("group").head(n)
        got = robustness.head_trades(trades, n, ["group", "tf"]).toPandas()
        assert sorted(zip(got["group"], got["exit_time"], got["entry_time"])) == sorted(zip(want["group"], want["exit_time"], want["entry_time"]))


def daily_table(spark, values):
    rows = [("g", "1h", name, (START + DAY * i).date(), v) for name, column in values.items() for i, v in enumerate(column) if v is not None]
    return spark.createDataFrame(rows, "`group` string, tf string, asset string, day date, daily_return double")


def test_gram_sums_equal_pairwise_statistics(spark):
    rng = np.random.default_rng(5)
    values = {n: [float(x) if rng.random() > 0.3 else None for x in rng.normal(i, 1 + i, 60)] for i, n in enumerate("abcd")}
    values["never with a"] = [1.0 if v is None else None for v in values["a"]]
    values["flat"] = [2.0] * 60
    table = pd.DataFrame(values).astype(float)
    for days in (7, 256):
        pairs = gram.pair_sums(daily_table(spark, values), ("group",), "asset", "daily_return", days=days)
        got = {(r.a, r.b): r for r in pairs.select("a", "b", "n", gram.covariance().alias("cov"), gram.correlation().alias("cor")).collect()}
        assert ("a", "never with a") not in got
        for a in table:
            for b in table:
                both = table[[a, b]].dropna() if a != b else pd.concat([table[a], table[a]], axis=1).dropna()
                if len(both):
                    assert got[a, b].n == len(both)
                    want = np.cov(both.to_numpy().T)[0, 1] if len(both) > 1 else None
                    assert got[a, b].cov == (None if want is None else pytest.approx(want, abs=1e-9))
                    if a != "flat" and b != "flat" and len(both) > 2 and both.std().min() > 0:
                        assert got[a, b].cor == pytest.approx(np.corrcoef(both.to_numpy().T)[0, 1], abs=1e-9)


def test_correlation_counts_days_without_returns_as_zero(spark):
    rng = np.random.default_rng(6)
    values = {n: [float(x) if rng.random() > 0.5 else None for x in rng.normal(size=50)] for n in ("one", "two", "three")}
    values["four"] = [None if v is not None else 1.0 for v in values["one"]]
    returns = daily_table(spark, values).withColumnRenamed("asset", "strategy")
    want = pd.DataFrame(values).astype(float).fillna(0.0).corr()
    got = compare.return_correlation(returns, least_days=30).collect()
    assert len(got) == 16
    for r in got:
        assert r.correlation == pytest.approx(want.loc[r.a, r.b], abs=1e-9)
    assert compare.return_correlation(returns, least_days=51).count() == 0
    assert compare.return_correlation(returns.where("strategy = 'one'"), least_days=1).count() == 0


def equity_table(spark, changes):
    """Equity that ends each day with the given changes."""
    rows = [("g", "1h", name, START + DAY * i, float(e)) for name, column in changes.items() for i, e in enumerate(np.cumsum([0.0, *column]))]
    return spark.createDataFrame(rows, "`group` string, tf string, asset string, timestamp timestamp_ntz, equity double")


def test_least_variance_weights(spark):
    rng = np.random.default_rng(7)
    common = rng.normal(size=40)
    changes = {"calm": rng.normal(size=40) * 0.5, "wild": rng.normal(size=40) * 3, "same": common, "more": common * 3 + rng.normal(size=40) * 0.1}
    weights = lambda c, **more: {r.asset: r.weight for r in portfolio.correlation_weights(equity_table(spark, c), method="min_var", **more).collect()}
    raw = np.linalg.solve(np.cov(np.array([changes[n] for n in sorted(changes)])), np.ones(4))
    assert raw.min() < 0
    kept = np.maximum(raw / raw.sum(), 0)
    got = weights(changes)
    assert [got[n] for n in sorted(changes)] == pytest.approx((kept / kept.sum()).tolist())
    # a matrix that can't be solved, and one that lacks a pair, mean inverse volatility
    singular = {"a": common, "flat": np.zeros(40), "b": rng.normal(size=40)}
    inverse = {r.asset: r.weight for r in portfolio.correlation_weights(equity_table(spark, singular)).collect()}
    assert weights(singular) == pytest.approx(inverse) and inverse["flat"] == 0.0
    assert weights({n: c[:3] for n, c in changes.items()}) == pytest.approx(dict.fromkeys(changes, 0.25))
    assert weights({"alone": common}) == {"alone": 1.0}


def test_sketched_quantiles_are_near_in_rank(spark):
    trades = hot_trades(spark)
    runs = robustness.monte_carlo_trades(trades, 200, keys=("group",)).where(F.col("group") != "hot")
    exact, near = robustness.quantile_cone(runs, ("group",)).toPandas(), robustness.quantile_cone(runs, ("group",), accuracy=100).toPandas()
    values = runs.toPandas()
    assert len(exact) == len(near)
    for r in near.itertuples():
        x = np.sort(values[(values["group"] == r.group) & (values["trade_no"] == r.trade_no)]["equity"])
        for share, q in ((0.05, r.q05), (0.5, r.q50), (0.95, r.q95)):
            lo, hi = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
            assert lo - 0.02 <= share <= hi + 0.02
    one, two = (robustness.monte_carlo_summary(runs, ("group",), accuracy=a).toPandas().sort_values("group") for a in (None, 10_000))
    np.testing.assert_allclose(one["mean_final"], two["mean_final"])


#: Parameter names of the strategies besides those that all have.
FIELDS = {
    "01": "fast slow", "02": "rsi_period rsi_lower rsi_upper adx_period adx_max use_adx_filter use_midline_exit", "08": "hurst_window hurst_n_min hurst_step hurst_trend_threshold hurst_mean_rev_threshold trend_fast trend_slow rsi_period rsi_lower rsi_upper use_regime_exit",
    "10": "n_states hmm_train_window hmm_prob_threshold hmm_exit_threshold rv_window vol_period sma_fast sma_slow use_hmm_exit",
    "13": "lr_period lr_mult slope_threshold mode", "14": "fft_window min_cycle_bars max_cycle_bars n_harmonics delta_min_atr min_power_fraction use_projection_exit use_cycle_exit",
}


def test_parameter_names_and_unknown_grid_names(spark):
    shared = {f.name for f in fields(st.Params)}
    for number, names in FIELDS.items():
        assert {f.name for f in fields(st.ALL[number].params_class)} - shared == set(names.split()), number
    with pytest.raises(ValueError, match="no parameter sma_quick"):
        walkforward.walk_forward(bars(spark, WALK), {"sma_quick": [1]}, st.SMACrossoverStrategy)
    grid = {"hurst_window": [64], "hurst_trend_threshold": [0.55], "hurst_mean_rev_threshold": [0.45], "trend_fast": [5, 10], "trend_slow": [20], "sl_atr_mult": [1.5, 2.0]}
    windows = walkforward.walk_forward(bars(spark, WALK * 2), grid, st.HurstRegimeStrategy, 1, 0.25).windows.collect()
    assert len(windows) == 1 and windows[0].param_trend_fast in ("5", "10", "20")


def test_short_windows_have_no_exponent():
    noise = np.random.default_rng(0).normal(size=64)
    assert np.isnan(recursion.hurst(noise[:12], 2)) and np.isnan(recursion.hurst(noise[:15], 2)) and not np.isnan(recursion.hurst(noise[:16], 2))
    assert np.isnan(recursion.hurst(noise[:31], 16)) and np.isnan(recursion.hurst(np.where(noise > 9, noise, 0.0), 8))


def test_fingerprint_follows_the_defaults(monkeypatch):
    from dataclasses import dataclass

    reg = compare.STRATEGY_REGISTRY[0]

    @dataclass(frozen=True)
    class Other(st.SMACrossoverParams):
        slow: int = 51

    changed = compare.StrategyRegistration(reg.name, reg.notebook_id, reg.strategy_cls, Other, reg.group_timeframes, reg.base_kwargs, reg.b3_overrides)
    assert compare.fingerprint(changed) != compare.fingerprint(reg) == compare.fingerprint(compare.STRATEGY_REGISTRY[0])


def test_combined_windows_join_the_assets_of_a_fold(spark):
    both = bars(spark, WALK).unionByName(bars(spark, WALK[::-1], "B"))
    windows, trades, equity = walkforward.walk_forward(both, {"fast": [2, 3], "slow": [5]}, st.SMACrossoverStrategy, 2, 0.4)
    got = {r.fold: r for r in walkforward.combined_windows(windows, trades).collect()}
    rows, each = trades.toPandas().sort_values(["exit_time", "asset", "entry_time"]), windows.toPandas()
    assert set(got) == {0, 1}
    for fold, r in got.items():
        part = rows[rows["fold"] == fold]
        curve = part["pnl_points"].cumsum()
        assert (r.num_trades, r.total_pnl) == (len(part), pytest.approx(part["pnl_points"].sum()))
        assert r.max_drawdown == pytest.approx((curve - curve.cummax()).min())
        mine = each[each["fold"] == fold]
        lead = mine[mine["asset"] == "A"].iloc[0]
        assert (r.is_start, r.oos_end, r.param_fast) == (lead["is_start"], lead["oos_end"], lead["param_fast"])
        mean = mine["degradation_ratio"].astype(float).mean()
        assert r.degradation_ratio == (None if math.isnan(mean) else pytest.approx(mean))
    # equity of the second fold starts where the first one ended
    for asset, curve in equity.toPandas().groupby("asset"):
        own = rows[rows["asset"] == asset]
        first = own[own["fold"] == 0]["pnl_points"].sum()
        curve = curve[curve["fold"] == 1].sort_values("timestamp")["equity"]
        assert curve.iloc[-1] == pytest.approx(first + own[own["fold"] == 1]["pnl_points"].sum())
