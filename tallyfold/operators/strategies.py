"""The fourteen rule strategies: indicators and signals over long bar tables.

A strategy turns bars into bars plus indicators, `atr` and `signal` (1, -1 or 0). Rules are column
expressions; of a long and a short rule that both hold, long wins. A rule whose inputs are null does
not hold. Signals outside the session and during warm-up are 0.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import kernels as k
from tallyfold.functions.mixture import regime_probabilities
from tallyfold.functions.recursion import Derived, Ewm, rolling_cycle, rolling_hurst, span, with_recursions


@dataclass(frozen=True)
class Params:
    """Execution parameters that every strategy has; fixed default values follow per strategy."""

    atr_period: int = 14
    sl_atr_mult: float = 2.0
    tp_atr_mult: float = 3.0
    session_start: int | None = None
    session_end: int | None = None
    sizing_mode: str = "unit"
    risk_fraction: float = 0.01

    def as_dict(self) -> dict:
        return asdict(self)


class Strategy:
    """Base: subclasses give `indicators`, `rules` and the columns of `warm_up`."""

    params_class: type[Params] = Params
    warm_up: tuple[str, ...] = ()

    def __init__(self, params: Params | None = None, keys=k.KEYS):
        self.params = params or self.params_class()
        self.keys = tuple(keys)
        self.check()

    def check(self) -> None:
        """Raise ValueError for parameters that make no sense."""

    def possible(self) -> bool:
        """False for combinations that are legal but never signal."""
        return True

    def indicators(self, df: DataFrame) -> DataFrame:
        return self.compute(k.with_atr(df, self.params.atr_period, self.keys))

    def compute(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def rules(self) -> tuple[Column, Column]:
        raise NotImplementedError

    def gate(self, signal: Column) -> Column:
        """Optional filters, before the session rule."""
        return signal

    def signals(self, df: DataFrame) -> DataFrame:
        df = self.indicators(df)
        if not self.possible():
            return df.withColumn("signal", F.lit(0))
        long, short = (F.coalesce(rule, F.lit(False)) for rule in self.rules())
        df = df.withColumns({"_long": long, "_short": short})
        signal = self.gate(F.when(F.col("_long"), 1).when(F.col("_short"), -1).otherwise(0))
        signal = k.session_only(signal, self.params.session_start, self.params.session_end)
        return df.withColumn("signal", k.guarded(signal, *self.warm_up).cast("int")).drop("_long", "_short")

    generate_signals = signals

    def cross(self, x: str, level: Column | float) -> tuple[Column, Column]:
        return k.crosses_up(x, level, self.keys), k.crosses_down(x, level, self.keys)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return k.previous(x, n, self.keys)


def _when_allowed(signal: Column, allowed: Column) -> Column:
    return F.when(F.coalesce(allowed, F.lit(False)), signal).otherwise(0)


def _rsi(n: int) -> list:
    """Wilder's index: 100 without losses, null without either."""

    def value(f: pd.DataFrame) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return 100.0 - 100.0 / (1.0 + f["_gain_avg"] / f["_loss_avg"])

    return [Ewm("_gain_avg", "_gain", 1.0 / n, n), Ewm("_loss_avg", "_loss", 1.0 / n, n), Derived("rsi", value, rowwise=True)]


def with_moves(df: DataFrame, keys) -> DataFrame:
    """Adds _gain and _loss, the clipped changes of the close."""
    change = F.col("close") - k.previous("close", 1, keys)
    return df.withColumns({"_gain": k.clip_low(change), "_loss": k.clip_low(-change)})


def with_directional(df: DataFrame, keys) -> DataFrame:
    """Adds _up and _down, the directional movements (0 on a series' first row)."""
    up, down = F.col("high") - k.previous("high", 1, keys), k.previous("low", 1, keys) - F.col("low")
    return df.withColumns({"_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_down": F.when((down > up) & (down > 0), down).otherwise(0.0)})


def _adx(n: int) -> list:
    def index(f: pd.DataFrame) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            plus, minus = 100.0 * f["_up_avg"] / f["_tr_avg"], 100.0 * f["_down_avg"] / f["_tr_avg"]
            return (100.0 * (plus - minus).abs() / (plus + minus)).replace([np.inf, -np.inf], np.nan)

    averages = [Ewm(f"{c}_avg", c, 1.0 / n, n) for c in ("_up", "_down")] + [Ewm("_tr_avg", "tr", 1.0 / n, n)]
    return [*averages, Derived("_dx", index, rowwise=True), Ewm("adx", "_dx", 1.0 / n, n)]


def rsi(df: DataFrame, n: int, keys=k.KEYS) -> DataFrame:
    return _tidy(with_recursions(with_moves(df, keys), _rsi(n), keys))


def adx(df: DataFrame, n: int, keys=k.KEYS, days: int | None = None) -> DataFrame:
    """Adds adx; needs tr."""
    return _tidy(with_recursions(with_directional(df, keys), _adx(n), keys, days))


def macd(df: DataFrame, fast: int, slow: int, signal: int, keys=k.KEYS, days: int | None = None) -> DataFrame:
    specs = [Ewm("_fast", "close", span(fast), fast), Ewm("_slow", "close", span(slow), slow), Derived("macd", lambda f: f["_fast"] - f["_slow"], rowwise=True), Ewm("macd_signal", "macd", span(signal), signal), Derived("macd_hist", lambda f: f["macd"] - f["macd_signal"], rowwise=True)]
    return _tidy(with_recursions(df, specs, keys, days))


def _tidy(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def ema(out: str, n: int, source: str = "close") -> Ewm:
    return Ewm(out, source, span(max(2, n)), max(2, n))


@dataclass(frozen=True)
class SMACrossoverParams(Params):
    fast: int = 20
    slow: int = 50


class SMACrossoverStrategy(Strategy):
    """A fast average crosses a slow one. Has no warm-up guard of its own."""

    params_class = SMACrossoverParams

    def compute(self, df):
        p = self.params
        df = df.withColumns({"sma_fast": k.sma("close", p.fast, self.keys), "sma_slow": k.sma("close", p.slow, self.keys)})
        return df.withColumn("sma_diff", F.col("sma_fast") - F.col("sma_slow"))

    def rules(self):
        return self.cross("sma_diff", 0.0)


@dataclass(frozen=True)
class RSIMeanReversionParams(Params):
    sl_atr_mult: float = 1.5
    tp_atr_mult: float = 2.0
    rsi_period: int = 14
    rsi_lower: float = 30.0
    rsi_upper: float = 70.0
    adx_period: int = 14
    adx_max: float = 25.0
    use_adx_filter: bool = False
    use_midline_exit: bool = False


class RSIMeanReversionStrategy(Strategy):
    """The index leaves an extreme zone; optionally only in weak trends."""

    params_class = RSIMeanReversionParams
    warm_up = ("atr", "rsi")

    def check(self):
        if not self.params.rsi_lower < 50 < self.params.rsi_upper:
            raise ValueError("rsi_lower must be below 50 and rsi_upper above it")

    def compute(self, df):
        p, df = self.params, with_moves(df, self.keys)
        specs = _rsi(p.rsi_period)
        if p.use_adx_filter:
            df, specs = with_directional(df, self.keys), specs + _adx(p.adx_period)
        return _tidy(with_recursions(df, specs, self.keys))

    def rules(self):
        return k.crosses_up("rsi", self.params.rsi_lower, self.keys), k.crosses_down("rsi", self.params.rsi_upper, self.keys)

    def gate(self, signal):
        return _when_allowed(signal, F.col("adx") < self.params.adx_max) if self.params.use_adx_filter else signal


@dataclass(frozen=True)
class BBSqueezeParams(Params):
    bb_period: int = 20
    bb_mult: float = 2.0
    squeeze_lookback: int = 20
    vol_period: int = 20
    vol_ratio_min: float = 1.5
    use_vol_filter: bool = False
    use_band_reentry_exit: bool = False


class _VolumeFiltered(Strategy):
    def with_volume(self, df: DataFrame) -> DataFrame:
        self._has_volume = self.params.use_vol_filter and "tick_vol" in df.columns
        return df.withColumn("vol_ratio", k.volume_ratio(self.params.vol_period, self.keys)) if self._has_volume else df

    def volume_gate(self, signal: Column) -> Column:
        return _when_allowed(signal, F.col("vol_ratio") >= self.params.vol_ratio_min) if self._has_volume else signal


class BBSqueezeStrategy(_VolumeFiltered):
    """The close leaves the bands one or two bars after they were at their tightest."""

    params_class = BBSqueezeParams
    warm_up = ("atr", "bb_upper", "bb_lower")

    def compute(self, df):
        p = self.params
        return self.with_volume(k.bollinger(df, p.bb_period, p.bb_mult, p.squeeze_lookback, self.keys))

    def rules(self):
        tight = (F.coalesce(self.lag("squeeze"), F.lit(0)) > 0) | (F.coalesce(self.lag("squeeze", 2), F.lit(0)) > 0)
        return (F.col("close") > F.col("bb_upper")) & tight, (F.col("close") < F.col("bb_lower")) & tight

    def gate(self, signal):
        return self.volume_gate(signal)


@dataclass(frozen=True)
class MACDHistogramParams(Params):
    tp_atr_mult: float = 3.5
    macd_fast: int = 12
    macd_slow: int = 26
    signal_period: int = 9
    vol_period: int = 20
    vol_ratio_min: float = 1.3
    use_vol_filter: bool = False
    use_zero_line_gate: bool = False
    use_decel_exit: bool = False


class MACDHistogramStrategy(_VolumeFiltered):
    """The histogram crosses zero; optionally only on the line's own side of zero."""

    params_class = MACDHistogramParams
    warm_up = ("atr", "macd_hist")

    def check(self):
        if self.params.macd_fast >= self.params.macd_slow:
            raise ValueError("macd_fast must be below macd_slow")

    def compute(self, df):
        p = self.params
        return self.with_volume(macd(df, p.macd_fast, p.macd_slow, p.signal_period, self.keys))

    def rules(self):
        return self.cross("macd_hist", 0.0)

    def gate(self, signal):
        if self.params.use_zero_line_gate:
            signal = F.when((signal == 1) & F.coalesce(F.col("macd") > 0, F.lit(False)), 1).when((signal == -1) & F.coalesce(F.col("macd") < 0, F.lit(False)), -1).otherwise(0)
        return self.volume_gate(signal)


@dataclass(frozen=True)
class DonchianParams(Params):
    sl_atr_mult: float = 3.0
    tp_atr_mult: float = 100.0
    dc_entry: int = 20
    dc_exit: int = 10
    use_tp: bool = False


class DonchianStrategy(Strategy):
    """Breakout of the wide channel, or of the narrow one against the standing trend."""

    params_class = DonchianParams
    warm_up = ("atr", "dc_entry_high", "dc_entry_low")

    def possible(self):
        return self.params.dc_exit < self.params.dc_entry

    def compute(self, df):
        p = self.params
        df = k.donchian(k.donchian(df, p.dc_entry, "dc_entry", self.keys), p.dc_exit, "dc_exit", self.keys)
        return df.withColumn("trend", k.trend_state(F.col("close") > F.col("dc_entry_high"), F.col("close") < F.col("dc_entry_low"), self.keys))

    def rules(self):
        close, before = F.col("close"), F.coalesce(self.lag("trend"), F.lit(0))
        up, down = (F.coalesce(c, F.lit(False)) for c in (close > F.col("dc_entry_high"), close < F.col("dc_entry_low")))
        return up | ((close > F.col("dc_exit_high")) & (before == -1)), down | ((close < F.col("dc_exit_low")) & (before == 1))


@dataclass(frozen=True)
class EMARibbonParams(Params):
    ema_p1: int = 5
    ema_p2: int = 8
    ema_p3: int = 13
    ema_p4: int = 21
    rsi_period: int = 14
    rsi_overbought: float = 65.0
    rsi_oversold: float = 35.0
    use_ribbon_exit: bool = False


class EMARibbonStrategy(Strategy):
    """Four averages fall into order, and the index is not extreme."""

    params_class = EMARibbonParams
    warm_up = ("atr", "ema4", "rsi")

    def possible(self):
        p = self.params
        return p.ema_p1 < p.ema_p2 < p.ema_p3 < p.ema_p4

    def compute(self, df):
        p = self.params
        lengths = (p.ema_p1, p.ema_p2, p.ema_p3, p.ema_p4)
        df = _tidy(with_recursions(with_moves(df, self.keys), [*[ema(f"ema{i}", n) for i, n in enumerate(lengths, 1)], *_rsi(p.rsi_period)], self.keys))
        e = [F.col(f"ema{i}") for i in range(1, 5)]
        ordered = lambda up: F.coalesce(*[(e[0] > e[1]) & (e[1] > e[2]) & (e[2] > e[3]) if up else (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3])], F.lit(False))
        return df.withColumns({"ribbon_up": ordered(True), "ribbon_down": ordered(False)})

    def rules(self):
        return k.rising_edge("ribbon_up", self.keys) & (F.col("rsi") < self.params.rsi_overbought), k.rising_edge("ribbon_down", self.keys) & (F.col("rsi") > self.params.rsi_oversold)


@dataclass(frozen=True)
class KeltnerParams(Params):
    sl_atr_mult: float = 2.5
    tp_atr_mult: float = 2.0
    kc_period: int = 20
    kc_atr_period: int = 10
    kc_mult: float = 2.0
    adx_period: int = 14
    adx_max: float = 25.0
    use_adx_filter: bool = True


class KeltnerReversionStrategy(Strategy):
    """The close is outside an average plus and minus ranges, in a weak trend."""

    params_class = KeltnerParams
    warm_up = ("atr", "kc_upper", "kc_lower")

    def compute(self, df):
        p = self.params
        df, specs = df.withColumn("kc_atr", k.sma("tr", p.kc_atr_period, self.keys)), [ema("kc_mid", p.kc_period)]
        if p.use_adx_filter:
            df, specs = with_directional(df, self.keys), specs + _adx(p.adx_period)
        df = _tidy(with_recursions(df, specs, self.keys))
        return df.withColumns({"kc_upper": F.col("kc_mid") + p.kc_mult * F.col("kc_atr"), "kc_lower": F.col("kc_mid") - p.kc_mult * F.col("kc_atr")})

    def rules(self):
        return F.col("close") <= F.col("kc_lower"), F.col("close") >= F.col("kc_upper")

    def gate(self, signal):
        return _when_allowed(signal, F.col("adx") < self.params.adx_max) if self.params.use_adx_filter else signal


@dataclass(frozen=True)
class HurstParams(Params):
    hurst_window: int = 128
    hurst_n_min: int = 8
    hurst_step: int = 4
    hurst_trend_threshold: float = 0.60
    hurst_mean_rev_threshold: float = 0.40
    trend_fast: int = 20
    trend_slow: int = 50
    rsi_period: int = 14
    rsi_lower: float = 30.0
    rsi_upper: float = 70.0
    use_regime_exit: bool = False


class HurstRegimeStrategy(Strategy):
    """Average crossings while returns persist, index reversals while they revert."""

    params_class = HurstParams
    warm_up = ("atr", "hurst", "sma_slow", "rsi")

    def compute(self, df):
        p = self.params
        regime = Derived("hurst", lambda f: rolling_hurst(f["close"].to_numpy(), p.hurst_window, p.hurst_n_min, p.hurst_step))
        df = _tidy(with_recursions(with_moves(df, self.keys), [*_rsi(p.rsi_period), regime], self.keys))
        df = df.withColumns({"sma_fast": k.sma("close", p.trend_fast, self.keys), "sma_slow": k.sma("close", p.trend_slow, self.keys)})
        return df.withColumn("sma_diff", F.col("sma_fast") - F.col("sma_slow"))

    def rules(self):
        p = self.params
        up, down = self.cross("sma_diff", 0.0)
        persists, reverts = (F.coalesce(c, F.lit(False)) for c in (F.col("hurst") > p.hurst_trend_threshold, F.col("hurst") < p.hurst_mean_rev_threshold))
        return (persists & up) | (reverts & k.crosses_up("rsi", p.rsi_lower, self.keys)), (persists & down) | (reverts & k.crosses_down("rsi", p.rsi_upper, self.keys))


@dataclass(frozen=True)
class DualThrustParams(Params):
    sl_atr_mult: float = 1.5
    tp_atr_mult: float = 2.5
    dt_lookback: int = 4
    k1: float = 0.5
    k2: float = 0.5
    session_start: int | None = 9
    session_end: int | None = 18
    entry_cutoff_minutes: int = 30


class DualThrustStrategy(Strategy):
    """The close leaves the day's open by a share of the last days' range, before the cutoff."""

    params_class = DualThrustParams
    warm_up = ("atr", "upper_trigger", "lower_trigger")

    def compute(self, df):
        p = self.params
        return k.dual_thrust(df, p.dt_lookback, p.k1, p.k2, p.session_start, p.session_end, self.keys)

    def rules(self):
        p = self.params
        allowed = k.in_session(p.session_start, p.session_end) & k.before_cutoff(p.session_end, p.entry_cutoff_minutes)
        return (F.col("close") > F.col("upper_trigger")) & allowed, (F.col("close") < F.col("lower_trigger")) & allowed


@dataclass(frozen=True)
class HMMRegimeParams(Params):
    tp_atr_mult: float = 3.5
    n_states: int = 3
    hmm_train_window: int = 504
    hmm_prob_threshold: float = 0.70
    hmm_exit_threshold: float = 0.40
    rv_window: int = 20
    vol_period: int = 20
    sma_fast: int = 20
    sma_slow: int = 50
    use_hmm_exit: bool = False


class HMMRegimeStrategy(Strategy):
    """Average crossings that a mixture model of returns, volatility and volume agrees with."""

    params_class = HMMRegimeParams
    warm_up = ("atr", "sma_slow", "p_bull")

    def compute(self, df):
        p = self.params
        df = df.withColumn("log_ret", k.log_return(self.keys)).withColumn("realised_vol", k.realised_vol("log_ret", p.rv_window, self.keys))
        features = ["log_ret", "realised_vol"]
        if "tick_vol" in df.columns:
            df = df.withColumn("vol_norm", k.volume_ratio(p.vol_period, self.keys))
            features.append("vol_norm")
        df = regime_probabilities(df, features, p.n_states, p.hmm_train_window, self.keys)
        df = df.withColumns({"sma_fast": k.sma("close", p.sma_fast, self.keys), "sma_slow": k.sma("close", p.sma_slow, self.keys), "regime": F.lit("")})
        return df.withColumn("sma_diff", F.col("sma_fast") - F.col("sma_slow"))

    def rules(self):
        up, down = self.cross("sma_diff", 0.0)
        least = self.params.hmm_prob_threshold
        return up & (F.col("p_bull") >= least), down & (F.col("p_bear") >= least)


@dataclass(frozen=True)
class VWAPReversionParams(Params):
    tp_atr_mult: float = 1.5
    n_sigma: float = 2.0
    vwap_volume_col: str = "tick_vol"
    vwap_warmup_bars: int = 10
    entry_cutoff_minutes: int = 30
    session_start: int | None = 9
    session_end: int | None = 18


class VWAPReversionStrategy(Strategy):
    """The close is n deviations from the session's volume-weighted price."""

    params_class = VWAPReversionParams
    warm_up = ("atr", "vwap_upper", "vwap_lower")

    def compute(self, df):
        p = self.params
        volume = next((c for c in (p.vwap_volume_col, "tick_vol", "volume") if c in df.columns), None)
        df = k.session_vwap(df, p.session_start, p.session_end, volume, self.keys)
        return df.withColumns({"vwap_upper": F.col("vwap") + p.n_sigma * F.col("vwap_sigma"), "vwap_lower": F.col("vwap") - p.n_sigma * F.col("vwap_sigma")})

    def rules(self):
        p = self.params
        allowed = k.in_session(p.session_start, p.session_end) & k.before_cutoff(p.session_end, p.entry_cutoff_minutes) & (F.col("session_bar") >= p.vwap_warmup_bars) & (F.col("vwap_sigma") > 0)
        return (F.col("close") <= F.col("vwap_lower")) & allowed, (F.col("close") >= F.col("vwap_upper")) & allowed


@dataclass(frozen=True)
class StochasticParams(Params):
    sl_atr_mult: float = 1.5
    tp_atr_mult: float = 2.0
    k_period: int = 14
    d_period: int = 3
    stoch_oversold: float = 20.0
    stoch_overbought: float = 80.0
    entry_mode: str = "crossover"
    use_d_filter: bool = False
    use_midline_exit: bool = False


class StochasticStrategy(Strategy):
    """The oscillator leaves an extreme zone; other entry modes never signal."""

    params_class = StochasticParams
    warm_up = ("atr", "stoch_k")

    def possible(self):
        return self.params.entry_mode == "crossover"

    def compute(self, df):
        return k.stochastic(df, self.params.k_period, self.params.d_period, self.keys)

    def rules(self):
        return k.crosses_up("stoch_k", self.params.stoch_oversold, self.keys), k.crosses_down("stoch_k", self.params.stoch_overbought, self.keys)

    def gate(self, signal):
        if not self.params.use_d_filter:
            return signal
        side = lambda s, ok: F.when((signal == s) & F.coalesce(ok, F.lit(False)), s)
        return F.coalesce(side(1, F.col("stoch_d") < 50), side(-1, F.col("stoch_d") > 50), F.lit(0))


@dataclass(frozen=True)
class LRChannelParams(Params):
    lr_period: int = 50
    lr_mult: float = 2.0
    slope_threshold: float = 0.3
    mode: str = "auto"


class LRChannelStrategy(Strategy):
    """Breakout of a regression channel along a steep slope, return into a flat one."""

    params_class = LRChannelParams
    warm_up = ("atr", "ols_line", "slope_norm")

    def compute(self, df):
        return k.ols_channel(df, self.params.lr_period, self.params.lr_mult, self.keys)

    def rules(self):
        p, close, steep = self.params, F.col("close"), F.col("slope_norm")
        mode = p.mode.lower()
        trend, revert = F.lit(mode != "reversion"), F.lit(mode != "trend")
        up, low = F.col("ols_upper"), F.col("ols_lower")
        strong, flat = F.abs(steep) >= p.slope_threshold, F.abs(steep) < p.slope_threshold
        breaks_up = trend & strong & (steep > 0) & (close > up) & (self.lag("close") <= self.lag("ols_upper"))
        breaks_down = trend & strong & (steep < 0) & (close < low) & (self.lag("close") >= self.lag("ols_lower"))
        no = F.lit(False)
        return F.coalesce(breaks_up, no) | F.coalesce(revert & flat & (close <= low), no), F.coalesce(breaks_down, no) | F.coalesce(revert & flat & (close >= up), no)


@dataclass(frozen=True)
class FFTCycleParams(Params):
    fft_window: int = 128
    min_cycle_bars: int = 8
    max_cycle_bars: int = 64
    n_harmonics: int = 0
    delta_min_atr: float = 0.1
    min_power_fraction: float = 0.0
    use_projection_exit: bool = False
    use_cycle_exit: bool = False


class FFTCycleFilterStrategy(Strategy):
    """The projected cycle turns by more than a share of the range (in log units)."""

    params_class = FFTCycleParams
    warm_up = ("atr", "fft_delta")

    def possible(self):
        p = self.params
        return p.min_cycle_bars < p.max_cycle_bars < p.fft_window // 2

    def compute(self, df):
        p = self.params
        spec = Derived("fft_delta", lambda f: rolling_cycle(f["close"].to_numpy(), p.fft_window, p.min_cycle_bars, p.max_cycle_bars, p.n_harmonics, p.min_power_fraction))
        return with_recursions(df, [spec], self.keys)

    def rules(self):
        least = self.params.delta_min_atr * F.try_divide(F.col("atr"), F.col("close"))
        return (F.col("fft_delta") > least) & (self.lag("fft_delta") <= 0), (F.col("fft_delta") < -least) & (self.lag("fft_delta") >= 0)


ALL = {
    "01": SMACrossoverStrategy, "02": RSIMeanReversionStrategy, "03": BBSqueezeStrategy, "04": MACDHistogramStrategy, "05": DonchianStrategy,
    "06": EMARibbonStrategy, "07": KeltnerReversionStrategy, "08": HurstRegimeStrategy, "09": DualThrustStrategy, "10": HMMRegimeStrategy,
    "11": VWAPReversionStrategy, "12": StochasticStrategy, "13": LRChannelStrategy, "14": FFTCycleFilterStrategy,
}
