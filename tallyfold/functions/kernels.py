"""Indicator kernels as Catalyst window expressions over long bar tables.

All kernels share one window (partition by series key, order by ts), so a strategy's indicators need
one exchange and one sort. A kernel is null until its window is full; divisions never raise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("group", "asset", "tf")


def series(keys=KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts")


def last_rows(n: int, keys=KEYS) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series(keys).rowsBetween(-(n - 1), 0)


def prior_rows(n: int, keys=KEYS) -> WindowSpec:
    """The n rows before the current one."""
    return series(keys).rowsBetween(-n, -1)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(agg: Callable[[Column], Column], x: Column | str, n: int, frame: WindowSpec) -> Column:
    """agg over the frame once it holds n values that are not null."""
    return F.when(F.count(col(x)).over(frame) == n, agg(col(x)).over(frame))


def previous(x: Column | str, k: int = 1, keys=KEYS) -> Column:
    return F.lag(col(x), k).over(series(keys))


def sma(x: Column | str, n: int, keys=KEYS) -> Column:
    return full(F.avg, x, n, last_rows(n, keys))


def true_range(keys=KEYS) -> Column:
    before = previous("close", 1, keys)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(df: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """Adds tr and atr (the simple mean of n true ranges)."""
    return df.withColumn("tr", true_range(keys)).withColumn("atr", sma("tr", n, keys))


def clip_low(x: Column) -> Column:
    """max(x, 0) that keeps null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def percent_change(x: Column | str, n: int, keys=KEYS) -> Column:
    return F.try_divide(col(x), previous(x, n, keys)) - 1


def forward_fill(x: Column | str, keys=KEYS) -> Column:
    return F.last(col(x), ignorenulls=True).over(series(keys).rowsBetween(Window.unboundedPreceding, 0))


def crosses_up(x: Column | str, level: Column | float, keys=KEYS) -> Column:
    level = level if isinstance(level, Column) else F.lit(level)
    return F.coalesce((col(x) > level) & (F.lag(col(x)).over(series(keys)) <= level), F.lit(False))


def crosses_down(x: Column | str, level: Column | float, keys=KEYS) -> Column:
    level = level if isinstance(level, Column) else F.lit(level)
    return F.coalesce((col(x) < level) & (F.lag(col(x)).over(series(keys)) >= level), F.lit(False))


def rising_edge(flag: Column | str, keys=KEYS) -> Column:
    """True where a boolean column turns true; it counts as false before the first row."""
    return col(flag) & ~F.coalesce(F.lag(col(flag)).over(series(keys)), F.lit(False))


def bollinger(df: DataFrame, n: int, mult: float, lookback: int | None = None, keys=KEYS) -> DataFrame:
    """Adds bb_mid, bb_upper, bb_lower, bb_width and, with a lookback, squeeze."""
    frame = last_rows(n, keys)
    spread = full(F.stddev_samp, "close", n, frame) * mult
    df = df.withColumns({"bb_mid": sma("close", n, keys), "bb_dev": spread})
    df = df.withColumns({"bb_upper": F.col("bb_mid") + F.col("bb_dev"), "bb_lower": F.col("bb_mid") - F.col("bb_dev")}).drop("bb_dev")
    df = df.withColumn("bb_width", F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")))
    if lookback is None:
        return df
    tightest = full(F.min, "bb_width", lookback, last_rows(lookback, keys))
    return df.withColumn("squeeze", F.coalesce((F.col("bb_width") <= tightest).cast("int"), F.lit(0)))


def volume_ratio(n: int, keys=KEYS) -> Column:
    return F.try_divide(F.col("tick_vol"), sma("tick_vol", n, keys))


def donchian(df: DataFrame, n: int, prefix: str, keys=KEYS) -> DataFrame:
    """Adds <prefix>_high and <prefix>_low over the n bars before the current one."""
    frame = prior_rows(n, keys)
    return df.withColumns({f"{prefix}_high": full(F.max, "high", n, frame), f"{prefix}_low": full(F.min, "low", n, frame)})


def trend_state(up: Column, down: Column, keys=KEYS) -> Column:
    """The last of +1 (up) and -1 (down) so far, 0 before any."""
    mark = F.when(up, 1).when(down, -1)
    return F.coalesce(forward_fill(mark, keys), F.lit(0))


def log_return(keys=KEYS) -> Column:
    return F.ln("close") - F.ln(previous("close", 1, keys))


def realised_vol(x: Column | str, n: int, keys=KEYS) -> Column:
    return full(F.stddev_pop, x, n, last_rows(n, keys))


def in_session(start: int, end: int) -> Column:
    return (F.hour("ts") >= start) & (F.hour("ts") < end)


def before_cutoff(end: int, minutes: int) -> Column:
    return F.hour("ts") * 60 + F.minute("ts") < end * 60 - minutes


def session_days(df: DataFrame, start: int, end: int, keys=KEYS) -> DataFrame:
    """OHLC of each calendar day's bars inside the session."""
    return df.where(in_session(start, end)).groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.min_by("open", "ts").alias("day_open"), F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.max_by("close", "ts").alias("day_close")
    )


def dual_thrust(df: DataFrame, days: int, k1: float, k2: float, start: int, end: int, keys=KEYS) -> DataFrame:
    """Adds upper_trigger and lower_trigger: the day's first session open plus and minus shares of
    the range of the session days before it."""
    frame = Window.partitionBy(*keys).orderBy("day").rowsBetween(-days, -1)
    extent = lambda agg, c: F.when(F.count(c).over(frame) == days, agg(c).over(frame))
    spread = F.greatest(extent(F.max, "day_high") - extent(F.min, "day_close"), extent(F.max, "day_close") - extent(F.min, "day_low"))
    daily = session_days(df, start, end, keys).withColumn("spread", spread)
    daily = daily.select(*keys, "day", (F.col("day_open") + k1 * F.col("spread")).alias("upper_trigger"), (F.col("day_open") - k2 * F.col("spread")).alias("lower_trigger"))
    return df.withColumn("day", F.to_date("ts")).join(daily, [*keys, "day"], "left").drop("day")


def session_vwap(df: DataFrame, start: int, end: int, volume: str | None, keys=KEYS) -> DataFrame:
    """Adds vwap, vwap_sigma and session_bar, cumulative over each day's session bars."""
    inside = in_session(start, end)
    raw = F.col(volume).cast("double") if volume else F.lit(1.0)
    weight = F.when(inside, F.when(raw > 0, raw).otherwise(1.0))
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    today = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_w": F.sum(weight).over(today), "_wp": F.sum(weight * price).over(today), "_wpp": F.sum(weight * price * price).over(today), "session_bar": F.count(weight).over(today)})
    mean = F.try_divide(F.col("_wp"), F.col("_w"))
    spread = F.greatest(F.lit(0.0), F.try_divide(F.col("_wpp"), F.col("_w")) - mean * mean)
    return df.withColumns({"vwap": F.when(inside, mean), "vwap_sigma": F.when(inside, F.sqrt(spread))}).drop("_w", "_wp", "_wpp")


def stochastic(df: DataFrame, k: int, d: int, keys=KEYS) -> DataFrame:
    """Adds stoch_k (50 while the range is unknown or zero) and stoch_d."""
    frame = last_rows(k, keys)
    low, high = full(F.min, "low", k, frame), full(F.max, "high", k, frame)
    ratio = F.when(high - low != 0, 100 * (F.col("close") - low) / (high - low))
    return df.withColumn("stoch_k", F.coalesce(ratio, F.lit(50.0))).withColumn("stoch_d", sma("stoch_k", d, keys))


def ols_channel(df: DataFrame, n: int, mult: float, keys=KEYS) -> DataFrame:
    """Adds ols_slope, ols_line (at the last bar), ols_upper, ols_lower and slope_norm (needs atr)."""
    frame = last_rows(n, keys)
    df = df.withColumn("_x", F.row_number().over(series(keys)).cast("double"))
    ready = F.count("close").over(frame) == n
    stat = lambda f: F.when(ready, f(F.col("close"), F.col("_x")).over(frame))
    df = df.withColumns({"ols_slope": stat(F.regr_slope), "_mean": stat(F.regr_avgy), "_sxy": stat(F.regr_sxy), "_syy": stat(F.regr_syy)})
    line = F.col("_mean") + F.col("ols_slope") * ((n - 1) / 2.0)
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("_syy") - F.col("ols_slope") * F.col("_sxy")) / (n - 2))
    df = df.withColumns({"ols_line": line, "ols_se": error})
    return df.withColumns({
        "ols_upper": F.col("ols_line") + mult * F.col("ols_se"), "ols_lower": F.col("ols_line") - mult * F.col("ols_se"),
        "slope_norm": F.try_divide(F.col("ols_slope") * n, F.col("atr")),
    }).drop("_x", "_mean", "_sxy", "_syy")


def session_only(signal: Column, start: int | None, end: int | None) -> Column:
    """The signal, or 0 outside the session if both hours are set."""
    return signal if start is None or end is None else F.when(in_session(start, end), signal).otherwise(0)


def guarded(signal: Column, *needed: str) -> Column:
    """The signal, or 0 while any needed column is null."""
    missing = F.lit(False)
    for name in needed:
        missing = missing | F.col(name).isNull()
    return F.when(missing, 0).otherwise(signal)


def windowed_bars(df: DataFrame, lookback: int, chunk: int | None = None, keys=KEYS) -> DataFrame:
    """Overlapping windows of bars: chunk_id is added and a bar appears once per window it is in.
    Window c covers rows [start, start + lookback + chunk), and the next one starts chunk + lookback
    rows after the last one's first new row, reaching lookback rows back."""
    if lookback < 0 or (chunk is not None and chunk <= 0):
        raise ValueError("lookback must be >= 0 and chunk_size > 0")
    size = chunk or max(1, lookback)
    step = lookback + size
    row = F.row_number().over(series(keys)) - 1
    df = df.withColumns({"_i": row, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    last = F.ceil(F.col("_n") / step).cast("int") - 1
    own = F.floor(F.col("_i") / step).cast("int")
    # window c is [c * step - lookback, (c + 1) * step), cut at both ends of the series
    upto = F.least(last, F.floor((F.col("_i") + lookback) / step).cast("int"))
    return df.withColumn("chunk_id", F.explode(F.sequence(own, F.greatest(own, upto)))).drop("_i", "_n")
