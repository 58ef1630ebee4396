import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import kernels as k
from tallyfold.functions import recursion
from tallyfold.operators import strategies as st

SCHEMA = "`group` string, asset string, tf string, ts timestamp_ntz, open double, high double, low double, close double, tick_vol double"
START = datetime.datetime(2024, 1, 1)


def bars(spark, closes, asset="A", step=datetime.timedelta(hours=1), wide=1.0):
    rows = [("g", asset, "1h", START + step * i, c, c + wide, c - wide, c, 1.0 + i % 3) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, SCHEMA)


def frame(df):
    return df.orderBy("asset", "ts").toPandas()


WALK = (100 + np.cumsum(np.random.default_rng(0).normal(size=120))).round(3).tolist()


def test_warm_up_of_windows(spark):
    df = frame(k.donchian(k.with_atr(bars(spark, range(1, 61)), 14), 10, "dc").withColumn("sma", k.sma("close", 5)))
    assert df["atr"].first_valid_index() == 13 and df["sma"].first_valid_index() == 4 and df["dc_high"].first_valid_index() == 10
    assert df["atr"][20] == 2.0 and df["sma"][4] == 3.0 and df["dc_high"][10] == 11.0


@pytest.mark.parametrize("n", [2, 14])
def test_ewm_and_index_match_pandas(spark, n):
    out = frame(st.rsi(k.with_atr(bars(spark, WALK), 14), n))
    diff = pd.Series(WALK).diff()
    gain, loss = (x.clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean() for x in (diff, -diff))
    np.testing.assert_allclose(out["rsi"], 100 - 100 / (1 + gain / loss), rtol=1e-12)
    assert out["rsi"].first_valid_index() == n


def test_index_without_losses_and_without_moves(spark):
    assert (frame(st.rsi(k.with_atr(bars(spark, range(1, 40)), 14), 14))["rsi"][14:] == 100).all()
    assert frame(st.rsi(k.with_atr(bars(spark, [5.0] * 40), 14), 14))["rsi"].isna().all()


def test_flat_series_have_no_division_by_zero(spark):
    flat = k.with_atr(bars(spark, [5.0] * 60, wide=0.0), 14)
    out = frame(k.ols_channel(k.session_vwap(k.stochastic(flat, 14, 3), 0, 24, "tick_vol"), 20, 2.0))
    assert (out["stoch_k"] == 50).all() and out["slope_norm"].isna().all()
    assert out["vwap_sigma"].max() < 1e-6 and out["ols_se"].dropna().max() < 1e-6


def test_ramp_has_slope_one_and_no_error(spark):
    out = frame(k.ols_channel(k.with_atr(bars(spark, range(1, 61)), 14), 20, 2.0)).dropna()
    np.testing.assert_allclose(out["ols_slope"], 1.0)
    np.testing.assert_allclose(out["ols_line"], out["close"])
    np.testing.assert_allclose(out["ols_se"], 0.0, atol=1e-6)


def test_average_through_gaps():
    x = pd.DataFrame({"x": [np.nan, 1.0, np.nan, 2.0, 3.0]})
    out = recursion.Ewm("y", "x", 0.5, 1).of(x)
    # the old weight decays through the gap: (0.25 * 1 + 0.5 * 2) / 0.75
    np.testing.assert_allclose(out, [np.nan, 1.0, 1.0, 1.25 / 0.75, (1.25 / 0.75 + 3.0) / 2])


def test_cycle_weights_equal_the_transform():
    logs = np.log(np.abs(np.random.default_rng(1).normal(size=64)) + 1)
    direct = recursion.cycle_delta(logs, 6, 20)
    assert abs(direct - recursion.cycle_weights(64, 6, 20) @ logs) < 1e-12
    assert np.isnan(recursion.cycle_delta(np.zeros(16), 2, 4))
    assert np.isnan(recursion.rolling_cycle(np.array([5.0] * 40), 16, 2, 4, 0, 0.0)).all()


def test_persistent_and_reverting_series_have_other_exponents():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=512)
    assert recursion.hurst(np.convolve(noise, np.ones(40) / 40)) > 0.75 > recursion.hurst(noise) > recursion.hurst(np.diff(noise))
    assert np.isnan(recursion.hurst(noise[:10]))


def test_window_chunks(spark):
    got = frame(k.windowed_bars(bars(spark, range(30)), 4, 3))
    spans = got.groupby("chunk_id")["close"].agg(["min", "max"]).to_numpy().astype(int).tolist()
    assert spans == [[0, 6], [3, 13], [10, 20], [17, 27], [24, 29]]
    with pytest.raises(ValueError):
        k.windowed_bars(bars(spark, range(3)), -1)


def test_impossible_parameters(spark):
    with pytest.raises(ValueError):
        st.RSIMeanReversionStrategy(st.RSIMeanReversionParams(rsi_lower=60))
    with pytest.raises(ValueError):
        st.MACDHistogramStrategy(st.MACDHistogramParams(macd_fast=30))
    never = [st.DonchianStrategy(st.DonchianParams(dc_entry=10, dc_exit=10)), st.EMARibbonStrategy(st.EMARibbonParams(ema_p1=9)), st.StochasticStrategy(st.StochasticParams(entry_mode="divergence")), st.FFTCycleFilterStrategy()]
    for s in never:
        assert s.signals(bars(spark, WALK)).where(F.col("signal") != 0).isEmpty()


def test_session_rule_and_series_do_not_mix(spark):
    both = bars(spark, WALK).unionByName(bars(spark, WALK[::-1], "B"))
    p = st.SMACrossoverParams(fast=2, slow=5)
    alone = frame(st.SMACrossoverStrategy(p).signals(bars(spark, WALK)))
    together = frame(st.SMACrossoverStrategy(p).signals(both))
    assert together[together.asset == "A"]["signal"].tolist() == alone["signal"].tolist()
    assert (alone["signal"] != 0).sum() > 5
    inside = frame(st.SMACrossoverStrategy(st.SMACrossoverParams(fast=2, slow=5, session_start=9, session_end=18)).signals(both))
    outside = ~inside["ts"].dt.hour.between(9, 17)
    assert (inside[outside]["signal"] == 0).all() and (inside["signal"] != 0).any()
