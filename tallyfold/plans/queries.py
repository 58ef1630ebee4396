"""Queries over the test tables, one or more per operator, with their SQL twins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions import kernels as k
from tallyfold.functions.recursion import Derived, rolling_cycle, rolling_hurst, with_recursions
from tallyfold.operators import compare, ml, portfolio, robustness, walkforward
from tallyfold.operators import strategies as st
from tallyfold.operators.backtest import Execution, equity_of, run, trades_of
from tallyfold.operators.metrics import compute_metrics, daily_changes, drawdown, metrics_comparison, metrics_table, subperiods
from tallyfold.plans import oracles as o
from tallyfold.sources.bars import load_all, resample_ohlc, save_csv, ticks_to_bars, ticks_to_frames
from tallyfold.staging import shared_folder, staged
from tallyfold.streaming.backtest import stream_backtest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(table(spark, sf_dir, "events"), "event_type", "ts", "value", "1h", ("event_id",))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "1D", ("o_orderkey",), group="daily")


def with_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.with_atr(hourly(spark, sf_dir), 14)


def rounded(df: DataFrame, *columns: str, plain: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    return df.select("asset", "ts", *plain, *[F.round(c, digits).alias(c) for c in columns])


_BAR = "asset, ts, open, high, low, close, tick_vol"


@query(o.query(o.BARS, select=f"SELECT {_BAR} FROM bars"))
def resample_ticks_1h(spark, sf_dir):
    return hourly(spark, sf_dir).select("asset", "ts", "open", "high", "low", "close", "tick_vol")


@query(o.query(o.BARS, select="SELECT asset, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(tick_vol) AS tick_vol FROM bars GROUP BY 1, 2"))
def resample_bars_4h(spark, sf_dir):
    return resample_ohlc(hourly(spark, sf_dir), "4h").select("asset", "ts", "open", "high", "low", "close", "tick_vol")


@query(o.query(o.framed_bars(("30min", "1h")), select="SELECT string_split(asset, '@')[1] AS asset, string_split(asset, '@')[2] AS tf, ts, open, high, low, close, tick_vol FROM bars"))
def bar_files(spark, sf_dir):
    """Bars written as files of the exporter's form, one per series, and read back by the catalog."""
    folder = f"{shared_folder(spark)}/tallyfold/bar-files-{uuid.uuid4().hex}"
    save_csv(framed(spark, sf_dir, ("30min", "1h")), folder)
    return load_all(spark, folder).select("asset", "tf", "ts", "open", "high", "low", "close", "tick_vol")


@query("""SELECT o_orderpriority AS asset, o_orderdate::DATE::TIMESTAMP AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS tick_vol FROM orders GROUP BY 1, 2""")
def daily_bars(spark, sf_dir):
    return order_bars(spark, sf_dir).select("asset", "ts", "open", "high", "low", "close", "tick_vol")


@query("""SELECT l_returnflag AS asset, l_shipdate::DATE::TIMESTAMP AS ts, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS tick_vol
    FROM lineitem GROUP BY 1, 2""")
def daily_volume_bars(spark, sf_dir):
    ticks = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    bars = ticks_to_bars(ticks, "l_returnflag", "l_shipdate", "price", "1D", ("l_orderkey", "l_linenumber"), "l_quantity", "daily_volume")
    return bars.select("asset", "ts", "high", "low", "tick_vol")


@query(o.query(*o.START, o.SMA, select=f"SELECT asset, ts, {o.r6('tr', 'atr', 'sma_fast', 'sma_slow', 'sma_diff')} FROM sma_d"))
def sma_and_atr(spark, sf_dir):
    return rounded(st.SMACrossoverStrategy().indicators(hourly(spark, sf_dir)), "tr", "atr", "sma_fast", "sma_slow", "sma_diff")


@query(o.query(*o.START, o.BOLLINGER, select=f"SELECT asset, ts, squeeze, {o.r6('bb_mid', 'bb_upper', 'bb_lower', 'bb_width')} FROM bb"))
def bollinger_squeeze(spark, sf_dir):
    return rounded(k.bollinger(with_atr(spark, sf_dir), 20, 2.0, 20), "bb_mid", "bb_upper", "bb_lower", "bb_width", plain=("squeeze",))


@query(o.query(*o.START, o.DONCHIAN, select="SELECT asset, ts, eh AS dc_entry_high, el AS dc_entry_low, xh AS dc_exit_high, xl AS dc_exit_low, trend FROM dc"))
def donchian_trend(spark, sf_dir):
    return st.DonchianStrategy().indicators(hourly(spark, sf_dir)).select("asset", "ts", "dc_entry_high", "dc_entry_low", "dc_exit_high", "dc_exit_low", "trend")


@query(o.query(*o.START, o.STOCHASTIC, select=f"SELECT asset, ts, {o.r6('stoch_k', 'stoch_d')} FROM st"))
def stochastic_oscillator(spark, sf_dir):
    return rounded(k.stochastic(with_atr(spark, sf_dir), 14, 3), "stoch_k", "stoch_d")


@query(o.query(*o.START, o.VWAP, select="SELECT asset, ts, session_bar, round(vwap, 4) AS vwap, round(vwap_sigma, 4) AS vwap_sigma FROM vw"))
def session_vwap(spark, sf_dir):
    df = k.session_vwap(with_atr(spark, sf_dir), 9, 18, "tick_vol")
    return df.select("asset", "ts", "session_bar", F.round("vwap", 4).alias("vwap"), F.round("vwap_sigma", 4).alias("vwap_sigma"))


@query(o.query(*o.START, o.DUAL_THRUST, select=f"SELECT asset, ts, {o.r6('upper_trigger', 'lower_trigger')} FROM dth"))
def dual_thrust_triggers(spark, sf_dir):
    return rounded(st.DualThrustStrategy().indicators(hourly(spark, sf_dir)), "upper_trigger", "lower_trigger")


@query(o.query(*o.START, o.ols(), select=f"SELECT asset, ts, {o.r6('ols_slope', 'ols_line', 'ols_upper', 'ols_lower', 'slope_norm')} FROM ols"))
def regression_channel(spark, sf_dir):
    return rounded(k.ols_channel(with_atr(spark, sf_dir), 50, 2.0), "ols_slope", "ols_line", "ols_upper", "ols_lower", "slope_norm")


@query(o.query(o.BARS, f"r AS (SELECT *, ln(close) - ln({o.lag('close')}) AS log_ret, close / {o.lag('close', 5)} - 1 AS change_5, tick_vol / ({o.full('avg', 'tick_vol', 20)}) AS vol_ratio FROM bars)",
    select=f"SELECT asset, ts, {o.r6('log_ret', 'change_5', 'vol_ratio')}, round({o.full('stddev_pop', 'log_ret', 20)}, 6) AS realised_vol FROM r"))
def returns_and_volume(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumns({"log_ret": k.log_return(), "change_5": k.percent_change("close", 5), "vol_ratio": k.volume_ratio(20)})
    return rounded(df.withColumn("realised_vol", k.realised_vol("log_ret", 20)), "log_ret", "change_5", "vol_ratio", "realised_vol")


@query(o.query(*o.START, *o.EMAS, select="SELECT asset, ts, " + ", ".join(f"round(e{i}_, 6) AS ema{i}" for i in range(1, 5)) + " FROM e4"))
def ema_ribbon(spark, sf_dir):
    return rounded(st.EMARibbonStrategy().indicators(hourly(spark, sf_dir)), "ema1", "ema2", "ema3", "ema4")


@query(o.query(*o.START, *o.rsi(14), select="SELECT asset, ts, round(rsi, 6) AS rsi FROM rsi_t"))
def wilder_rsi(spark, sf_dir):
    return rounded(st.rsi(with_atr(spark, sf_dir), 14), "rsi")


@query(o.query(*o.START, *o.MACD, select=f"SELECT asset, ts, {o.r6('macd', 'macd_signal', 'macd_hist')} FROM macd_t"))
def macd_lines(spark, sf_dir):
    return rounded(st.macd(with_atr(spark, sf_dir), 12, 26, 9), "macd", "macd_signal", "macd_hist")


@query(o.query(*o.START, *o.adx(14), select="SELECT asset, ts, round(adx, 6) AS adx FROM adx_t"))
def directional_index(spark, sf_dir):
    return rounded(st.adx(with_atr(spark, sf_dir), 14), "adx")


@query(o.query(*o.START, *o.KELTNER, select=f"SELECT asset, ts, {o.r6('kc_mid', 'kc_upper', 'kc_lower')} FROM kc"))
def keltner_channel(spark, sf_dir):
    return rounded(st.KeltnerReversionStrategy().indicators(hourly(spark, sf_dir)), "kc_mid", "kc_upper", "kc_lower")


# The same averages, each series in blocks of three days.
_SCANNED = 3


@query(o.query(*o.START, *o.EMAS, select="SELECT asset, ts, " + ", ".join(f"round(e{i}_, 6) AS ema{i}" for i in range(1, 5)) + " FROM e4"))
def ema_ribbon_scanned(spark, sf_dir):
    specs = [st.ema(f"ema{i}", n) for i, n in enumerate((5, 8, 13, 21), 1)]
    return rounded(with_recursions(with_atr(spark, sf_dir), specs, days=_SCANNED), "ema1", "ema2", "ema3", "ema4")


@query(o.query(*o.START, *o.MACD, select=f"SELECT asset, ts, {o.r6('macd', 'macd_signal', 'macd_hist')} FROM macd_t"))
def macd_lines_scanned(spark, sf_dir):
    return rounded(st.macd(with_atr(spark, sf_dir), 12, 26, 9, days=_SCANNED), "macd", "macd_signal", "macd_hist")


@query(o.query(*o.START, *o.adx(14), select="SELECT asset, ts, round(adx, 6) AS adx FROM adx_t"))
def directional_index_scanned(spark, sf_dir):
    return rounded(st.adx(with_atr(spark, sf_dir), 14, days=_SCANNED), "adx")


@query(o.query(*o.START, o.fft(32, 4, 12), select="SELECT asset, ts, round(fft_delta, 6) AS fft_delta FROM fft"))
def cycle_projection(spark, sf_dir):
    spec = Derived("fft_delta", lambda f: rolling_cycle(f["close"].to_numpy(), 32, 4, 12, 0, 0.0))
    return rounded(with_recursions(hourly(spark, sf_dir), [spec]), "fft_delta")


@query(o.query(*o.START, o.harmonics(64, 6, 24, 3, 0.05), select="SELECT asset, ts, round(fft_delta, 6) AS fft_delta FROM fft"))
def cycle_projection_top_harmonics(spark, sf_dir):
    spec = Derived("fft_delta", lambda f: rolling_cycle(f["close"].to_numpy(), 64, 6, 24, 3, 0.05))
    return rounded(with_recursions(hourly(spark, sf_dir), [spec]), "fft_delta")


@query(o.query(*o.START, *o.hurst(128, 8, 4), select="SELECT asset, ts, round(hurst, 6) AS hurst FROM hurst_t"))
def hurst_exponent(spark, sf_dir):
    spec = Derived("hurst", lambda f: rolling_hurst(f["close"].to_numpy(), 128, 8, 4))
    return rounded(with_recursions(hourly(spark, sf_dir), [spec]), "hurst")


@query()
def regime_mixture(spark, sf_dir):
    return rounded(st.HMMRegimeStrategy().indicators(hourly(spark, sf_dir)), "p_bull", "p_bear")


@query(o.query(o.BARS, "i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS r, count(*) OVER (PARTITION BY asset) AS n FROM bars)",
    select="SELECT asset, ts, c::INTEGER AS chunk_id FROM i, unnest(range(0, 1000)) AS u(c) WHERE c < ceil(n / 150.0) AND r >= c * 150 - 50 AND r < (c + 1) * 150"))
def overlapping_windows(spark, sf_dir):
    return k.windowed_bars(hourly(spark, sf_dir), 50, 100).select("asset", "ts", "chunk_id")


# Parameters that differ from the defaults, so that hourly noise gives signals.
_CHOSEN = {"11": {"n_sigma": 1.0, "vwap_warmup_bars": 3}, "14": {"fft_window": 32, "min_cycle_bars": 4, "max_cycle_bars": 12}}


def strategy(number: str):
    cls = st.ALL[number]
    return cls(cls.params_class(**_CHOSEN.get(number, {})))


def _signal_query(number: str):
    def signals(spark, sf_dir):
        return strategy(number).signals(hourly(spark, sf_dir)).select("asset", "ts", "signal")

    sql = o.query(*o.SIGNALS[number], select="SELECT asset, ts, signal FROM sig") if number in o.SIGNALS else None
    query(sql, f"signals_{number}_{st.ALL[number].__name__.removesuffix('Strategy').lower()}")(signals)


for _number in st.ALL:
    _signal_query(_number)


def backtest(spark, sf_dir, number: str = "01", slippage: float = 0.0, **changes) -> DataFrame:
    from dataclasses import replace

    chosen = strategy(number)
    return staged(run(chosen.signals(hourly(spark, sf_dir)), replace(Execution.of(chosen.params, slippage), **changes)), "backtest")


def _trades(result: DataFrame) -> DataFrame:
    return _rounded_trades(trades_of(result))


def _rounded_trades(t: DataFrame) -> DataFrame:
    return t.select("asset", "entry_time", "exit_time", "direction", F.round("entry", 6).alias("entry"), F.round("exit", 6).alias("exit"), "reason", F.round("pnl_points", 6).alias("pnl_points"), "bars_held", F.round("size", 6).alias("size"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), select=f"SELECT asset, {o.TRADE_COLUMNS} FROM trades"))
def backtest_trades(spark, sf_dir):
    return _trades(backtest(spark, sf_dir))


@query(o.query(*o.SIGNALS["05"], o.stepper(3.0, 100.0, True, "fixed_frac", 0.5), select=f"SELECT asset, {o.TRADE_COLUMNS} FROM trades"))
def backtest_trades_sessions_fixed_fraction(spark, sf_dir):
    return _trades(backtest(spark, sf_dir, "05", 0.5, session_start=9, session_end=18, sizing_mode="fixed_frac"))


@query(o.query(*o.SIGNALS["12"], o.stepper(1.5, 2.0, False, "vol_scaled"), select=f"SELECT asset, {o.TRADE_COLUMNS} FROM trades"))
def backtest_trades_volatility_scaled(spark, sf_dir):
    return _trades(backtest(spark, sf_dir, "12", sizing_mode="vol_scaled"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), select=f"SELECT asset, {o.TRADE_COLUMNS} FROM trades"))
def backtest_trades_streamed(spark, sf_dir):
    """The same trades from a stream: bars with signals arrive in files of eight days, then a row
    without prices that ends each series."""
    signals = strategy("01").signals(hourly(spark, sf_dir)).select(*k.KEYS, "ts", "high", "low", "close", "atr", "signal")
    signals = staged(signals, "signals")
    folder = f"{shared_folder(spark)}/tallyfold/stream-{uuid.uuid4().hex}"
    first, last = signals.agg(F.min("ts"), F.max("ts")).first()
    step = F.expr("interval 8 days")
    for i in range((last - first).days // 8 + 1):
        since = F.lit(first) + i * step
        signals.where((F.col("ts") >= since) & (F.col("ts") < since + step)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    none = [F.lit(None).cast("double").alias(c) for c in ("high", "low", "close", "atr")]
    signals.groupBy(*k.KEYS).agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts")).select(*k.KEYS, "ts", *none, F.lit(0).alias("signal")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    arriving = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    trades = stream_backtest(arriving, Execution(2.0, 3.0), lateness="1 day")
    run_ = trades.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run_.awaitTermination()
    return _rounded_trades(spark.read.schema(trades.schema).parquet(f"{folder}/out"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), select='SELECT asset, "timestamp", round(equity, 5) AS equity FROM equity'))
def backtest_equity(spark, sf_dir):
    return equity_of(backtest(spark, sf_dir)).select("asset", "timestamp", F.round("equity", 5).alias("equity"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), select='SELECT asset, "timestamp", round(equity - max(equity) OVER (PARTITION BY asset ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING), 5) AS drawdown FROM equity'))
def drawdown_curve(spark, sf_dir):
    return drawdown(equity_of(backtest(spark, sf_dir))).select("asset", "timestamp", F.round("drawdown", 5).alias("drawdown"))


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "num_trades", F.round("total_pnl", 4).alias("total_pnl"), F.round("win_rate", 6).alias("win_rate"), F.round("avg_win", 4).alias("avg_win"), F.round("avg_loss", 4).alias("avg_loss"),
        F.round("profit_factor", 6).alias("profit_factor"), F.round("expectancy", 4).alias("expectancy"), F.round("max_drawdown", 4).alias("max_drawdown"), "max_consec_losses",
        F.round("sharpe_daily", 5).alias("sharpe_daily"), F.round("t_stat", 5).alias("t_stat"),
    )


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), o.metrics("asset"), select="SELECT * FROM metrics"))
def trade_metrics(spark, sf_dir):
    result = backtest(spark, sf_dir)
    return _metrics(compute_metrics(trades_of(result), equity_of(result), p_value=False), "asset")


@query()
def trade_metrics_p_value(spark, sf_dir):
    result = backtest(spark, sf_dir)
    return metrics_table(compute_metrics(trades_of(result), equity_of(result), all_keys=result)).select("asset", "place", "metric", F.round("value", 6).alias("value"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), select="""SELECT asset, trade_no, round(rate, 6) AS rolling_win_rate FROM (
    SELECT asset, n AS trade_no, CASE WHEN n >= 20 THEN avg(w) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS rate
    FROM (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY exit_time, entry_time) AS n, CASE WHEN pnl_points > 0 THEN 1.0 ELSE 0.0 END AS w FROM trades))"""))
def rolling_win_rate(spark, sf_dir):
    w = Window.partitionBy("asset").orderBy("exit_time", "entry_time")
    t = trades_of(backtest(spark, sf_dir)).select("asset", F.row_number().over(w).alias("trade_no"), (F.col("pnl_points") > 0).cast("double").alias("won"))
    frame = Window.partitionBy("asset").orderBy("trade_no").rowsBetween(-19, 0)
    return t.select("asset", "trade_no", F.round(F.when(F.col("trade_no") >= 20, F.avg("won").over(frame)), 6).alias("rolling_win_rate"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), select="""SELECT asset, least(b, 40)::INTEGER AS bin, count(*) AS trades FROM (
    SELECT asset, floor((pnl_points - lo) / ((hi - lo) / 40)) + 1 AS b FROM trades JOIN (SELECT asset, min(pnl_points) AS lo, max(pnl_points) AS hi FROM trades GROUP BY 1) USING (asset)) GROUP BY 1, 2"""))
def pnl_histogram(spark, sf_dir):
    t = trades_of(backtest(spark, sf_dir)).select("asset", "pnl_points")
    ends = t.groupBy("asset").agg(F.min("pnl_points").alias("lo"), F.max("pnl_points").alias("hi"))
    place = F.least(F.lit(40), F.floor((F.col("pnl_points") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)) + 1)
    return t.join(ends, "asset").groupBy("asset", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("trades"))


_PORTFOLIO = """merged AS (SELECT asset, entry_time, exit_time, pnl_points, sum(pnl_points) OVER (ORDER BY exit_time, asset, entry_time ROWS UNBOUNDED PRECEDING) AS equity FROM trades)"""


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), _PORTFOLIO, select="SELECT asset, entry_time, exit_time, round(equity, 5) AS equity FROM merged"))
def portfolio_equity(spark, sf_dir):
    return portfolio.merged(trades_of(backtest(spark, sf_dir))).select("asset", "entry_time", "exit_time", F.round("equity", 5).alias("equity"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), o.daily("asset"), select="SELECT asset, day, round(daily_return, 5) AS daily_return FROM changes"))
def daily_returns(spark, sf_dir):
    return daily_changes(equity_of(backtest(spark, sf_dir))).select("asset", "day", F.round("daily_return", 5).alias("daily_return"))


_COV = """pairs AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.daily_return, y.daily_return) AS covariance, corr(x.daily_return, y.daily_return) AS correlation FROM changes x JOIN changes y ON x.day = y.day GROUP BY 1, 2)"""


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), o.daily("asset"), _COV, select="SELECT a, b, round(covariance, 4) AS covariance, round(correlation, 6) AS correlation FROM pairs"))
def return_covariance(spark, sf_dir):
    pairs = portfolio.covariances(daily_changes(equity_of(backtest(spark, sf_dir))))
    return pairs.select("a", "b", F.round("covariance", 4).alias("covariance"), F.round("correlation", 6).alias("correlation"))


_WEIGHTS = """recent AS (SELECT * FROM changes WHERE day IN (SELECT day FROM (SELECT DISTINCT day FROM changes) ORDER BY day DESC LIMIT 60)),
    weights AS (SELECT asset, w / sum(w) OVER () AS weight FROM (SELECT asset, 1 / nullif(stddev_samp(daily_return), 0) AS w FROM recent GROUP BY 1))"""


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), o.daily("asset"), _WEIGHTS, select="SELECT asset, round(weight, 6) AS weight FROM weights"))
def inverse_volatility_weights(spark, sf_dir):
    return portfolio.correlation_weights(equity_of(backtest(spark, sf_dir))).select("asset", F.round("weight", 6).alias("weight"))


_GAUSS = """cov AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.daily_return, y.daily_return) AS c FROM recent x JOIN recent y ON x.day = y.day GROUP BY 1, 2),
    lines AS (SELECT a, list(c ORDER BY b) || [1.0::DOUBLE] AS line FROM cov GROUP BY 1),
    steps_m AS (SELECT 1 AS k, list(line ORDER BY a) AS m, list(a ORDER BY a) AS names, count(*) AS n FROM lines
        UNION ALL SELECT k + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN i = k THEN list_transform(m[i], lambda x: x / m[i][i])
            ELSE list_transform(range(1, n + 2), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END), names, n FROM steps_m WHERE k <= n),
    solved AS (SELECT unnest(names) AS asset, unnest(list_transform(m, lambda l: l[n + 1])) AS raw FROM steps_m WHERE k = n + 1),
    least AS (SELECT asset, greatest(raw / sum(raw) OVER (), 0) AS w FROM solved),
    lv AS (SELECT asset, w / sum(w) OVER () AS weight FROM least)"""


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), o.daily("asset"), _WEIGHTS, _GAUSS, select="SELECT asset, round(weight, 6) AS weight FROM lv"))
def least_variance_weights(spark, sf_dir):
    return portfolio.correlation_weights(equity_of(backtest(spark, sf_dir)), method="min_var").select("asset", F.round("weight", 6).alias("weight"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), o.daily("asset"), _WEIGHTS, select="""SELECT asset, exit_time, entry_time, round(pnl_points * weight, 5) AS pnl_weighted,
    round(sum(pnl_points * weight) OVER (ORDER BY exit_time, asset, entry_time ROWS UNBOUNDED PRECEDING), 5) AS equity FROM trades JOIN weights USING (asset)"""))
def weighted_portfolio_equity(spark, sf_dir):
    result = backtest(spark, sf_dir)
    out = portfolio.weighted_portfolio(trades_of(result), portfolio.correlation_weights(equity_of(result)))
    return out.select("asset", "exit_time", "entry_time", F.round("pnl_weighted", 5).alias("pnl_weighted"), F.round("equity", 5).alias("equity"))


@query("""WITH b AS (SELECT o_orderpriority AS asset, o_orderdate::DATE::TIMESTAMP AS ts, arg_max(o_totalprice, o_orderkey) AS close, arg_min(o_totalprice, o_orderkey) AS open FROM orders GROUP BY 1, 2),
    t AS (SELECT asset, year(ts) AS period, ts, close - open AS p FROM b)
    SELECT asset, period::INTEGER AS period, count(*) AS num_trades, round(sum(p), 2) AS total_pnl, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM t GROUP BY 1, 2""")
def subperiod_metrics(spark, sf_dir):
    """One trade per day and asset, from open to close."""
    bars = order_bars(spark, sf_dir)
    t = bars.select("group", "asset", "tf", F.col("ts").alias("entry_time"), F.col("ts").alias("exit_time"), (F.col("close") - F.col("open")).alias("pnl_points"))
    return subperiods(t).select("asset", "period", "num_trades", F.round("total_pnl", 2).alias("total_pnl"), F.round("win_rate", 6).alias("win_rate"))


# Three strategies side by side, as the comparison tables have them.
_SIDE = ("01", "05", "12")


def _sided() -> list[str]:
    """One CTE all_sig with a strategy column; each strategy's CTEs sit in a sub-query."""
    parts = " UNION ALL ".join(f"SELECT '{n}' AS strategy, * FROM ({o.query(*o.SIGNALS[n], select='SELECT asset, ts, high, low, close, atr, signal FROM sig')})" for n in _SIDE)
    return [f"all_sig AS ({parts})", o.stepper(2.0, 3.0, sig="all_sig", keys="strategy, asset")]


def sided(spark, sf_dir) -> DataFrame:
    bars = hourly(spark, sf_dir)
    rules = Execution(2.0, 3.0)
    parts = [run(strategy(n).signals(bars), rules).withColumn("strategy", F.lit(n)) for n in _SIDE]
    return staged(reduce(DataFrame.unionByName, parts), "sided")


def sided_metrics(spark, sf_dir) -> DataFrame:
    result = sided(spark, sf_dir)
    return compute_metrics(trades_of(result, compare.FULL), equity_of(result, compare.FULL), compare.FULL, p_value=False)


_SIDED = [*_sided(), o.metrics("strategy, asset")]


@query(o.query(*_SIDED, select="SELECT strategy, asset, round(total_pnl, 4) AS total_pnl, num_trades FROM metrics ORDER BY total_pnl DESC, strategy, asset LIMIT 7"))
def leaderboard_top(spark, sf_dir):
    return compare.leaderboard(sided_metrics(spark, sf_dir), "total_pnl", 7).select("strategy", "asset", F.round("total_pnl", 4).alias("total_pnl"), "num_trades")


@query(o.query(*_SIDED, select="SELECT strategy, " + ", ".join(f"max(CASE WHEN asset = '{a}' THEN num_trades END) AS {a}" for a in ("click", "error", "purchase", "signup", "view")) + " FROM metrics GROUP BY 1"))
def metric_pivot(spark, sf_dir):
    return compare.pivot_metric(sided_metrics(spark, sf_dir), "num_trades", "ticks", "1h")


@query(o.query(*_SIDED, select="SELECT strategy, round(avg(win_rate), 5) AS ticks FROM metrics GROUP BY 1"))
def group_breakdown(spark, sf_dir):
    out = compare.group_aggregated_metrics(sided_metrics(spark, sf_dir), "win_rate")
    return out.select("strategy", F.round("ticks", 5).alias("ticks"))


@query(o.query(*_SIDED, select="SELECT asset, count(DISTINCT strategy) AS strategies FROM trades GROUP BY 1"))
def coverage_count(spark, sf_dir):
    return compare.coverage(trades_of(sided(spark, sf_dir), compare.FULL)).select("asset", "strategies")


@query(o.query(*_SIDED, select="SELECT strategy, min(num_trades) AS low, quantile_cont(num_trades, 0.25) AS q25, median(num_trades) AS median, quantile_cont(num_trades, 0.75) AS q75, max(num_trades) AS high, count(*) AS series FROM metrics GROUP BY 1"))
def metric_spread(spark, sf_dir):
    return compare.metric_distribution(sided_metrics(spark, sf_dir), "num_trades")


@query(o.query(*_SIDED, select="SELECT asset, strategy, place::INTEGER AS place FROM (SELECT asset, strategy, row_number() OVER (PARTITION BY asset ORDER BY total_pnl DESC, strategy) AS place FROM metrics) WHERE place <= 2"))
def best_strategies(spark, sf_dir):
    return compare.top_strategies(sided_metrics(spark, sf_dir), "total_pnl", 2).select("asset", "strategy", "place")


@query(o.query(*_SIDED, select="""SELECT strategy, asset, "timestamp", round(equity, 5) AS equity FROM equity
    SEMI JOIN (SELECT strategy, asset FROM (SELECT strategy, asset, row_number() OVER (PARTITION BY asset ORDER BY total_pnl DESC, strategy) AS place FROM metrics) WHERE place <= 1) USING (strategy, asset)"""))
def best_equity_curves(spark, sf_dir):
    result = sided(spark, sf_dir)
    equity = equity_of(result, compare.FULL)
    ranks = compute_metrics(trades_of(result, compare.FULL), equity, compare.FULL, p_value=False)
    return compare.equity_overlay(ranks, equity, "total_pnl", 1).select("strategy", "asset", "timestamp", F.round("equity", 5).alias("equity"))


@query(o.query(*_SIDED, """sums AS (SELECT day, strategy, sum(daily_return) AS x FROM changes GROUP BY 1, 2),
    grid AS (SELECT d.day, s.strategy, coalesce(m.x, 0) AS x FROM (SELECT DISTINCT day FROM sums) d CROSS JOIN (SELECT DISTINCT strategy FROM sums) s LEFT JOIN sums m ON m.day = d.day AND m.strategy = s.strategy)""",
    select="SELECT l.strategy AS a, r.strategy AS b, round(corr(l.x, r.x), 6) AS correlation FROM grid l JOIN grid r USING (day) GROUP BY 1, 2 HAVING count(*) >= 20"))
def strategy_correlation(spark, sf_dir):
    returns = compare.daily_returns_from_equity(equity_of(sided(spark, sf_dir), compare.FULL))
    return compare.return_correlation(returns, least_days=20).select("a", "b", F.round("correlation", 6).alias("correlation"))


@query("""SELECT 'missing' AS kind, r_name AS name FROM region WHERE r_name NOT IN (SELECT r_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey)
    UNION ALL SELECT DISTINCT 'shared', r_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def group_sets(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    found = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    left = compare.missing_groups(region, found, "r_name").select(F.lit("missing").alias("kind"), F.col("r_name").alias("name"))
    return left.unionByName(compare.shared_groups(region, found, "r_name").select(F.lit("shared").alias("kind"), F.col("r_name").alias("name")))


_REACHED = "region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey"
_LEVELS = (("region", "r_name"), ("nation", "n_name"))


@query(" UNION ALL ".join(f"""SELECT '{t}' AS level, 'missing' AS kind, {c} AS name FROM {t} WHERE {c} NOT IN (SELECT {c} FROM {_REACHED})
    UNION ALL SELECT DISTINCT '{t}', 'shared', {c} FROM {_REACHED}""" for t, c in _LEVELS))
def group_sets_whole(spark, sf_dir):
    """group_sets over whole tables: regions and nations against those that suppliers reach."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    found = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = []
    for (level, column), wanted in zip(_LEVELS, (region, nation), strict=True):
        for kind, sets in (("missing", compare.missing_groups), ("shared", compare.shared_groups)):
            parts.append(sets(wanted, found, column).select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.col(column).alias("name")))
    return reduce(DataFrame.unionByName, parts)


def framed(spark, sf_dir, frames: tuple[str, ...] = o.FRAMES) -> DataFrame:
    ticks = table(spark, sf_dir, "events")
    return ticks_to_frames(ticks, "event_type", "ts", "value", frames, ("event_id",))


_TABLE = ("num_trades", "total_pnl", "win_rate", "avg_win", "avg_loss", "profit_factor", "expectancy", "max_drawdown", "max_consec_losses", "sharpe_daily", "t_stat", "t_stat")


@query(o.query(o.framed_bars(("1h", "4h")), o.TR, o.atr(), *o.sma_signals(20, 50, ()), o.stepper(2.0, 3.0), o.metrics("asset"),
    "long_m AS (" + " UNION ALL ".join(f"SELECT string_split(asset, '@')[1] AS asset, string_split(asset, '@')[2] AS tf, {i} AS place, {m}::DOUBLE AS value FROM metrics" for i, m in enumerate(_TABLE)) + ")",
    f"names(place, metric) AS (VALUES {', '.join(str((i, m)) for i, m in enumerate((*_TABLE[:10], 'sharpe_per_trade', 't_stat')))})",
    select="""SELECT asset, place::INTEGER AS place, metric, max(CASE WHEN tf = '1h' THEN value END) AS "1h", max(CASE WHEN tf = '4h' THEN value END) AS "4h" FROM long_m JOIN names USING (place) GROUP BY 1, 2, 3"""))
def metrics_by_timeframe(spark, sf_dir):
    result = staged(run(st.SMACrossoverStrategy().signals(framed(spark, sf_dir, ("1h", "4h"))), Execution(2.0, 3.0)), "timeframes")
    return metrics_comparison(_metrics(compute_metrics(trades_of(result), equity_of(result), p_value=False), "asset", "tf").withColumn("sharpe_per_trade", F.col("t_stat")), "tf", keys=("asset",))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), select=f"SELECT asset, {o.TRADE_COLUMNS} FROM trades QUALIFY row_number() OVER (PARTITION BY asset ORDER BY exit_time, entry_time) <= 10"))
def earliest_trades(spark, sf_dir):
    """The report of each series' first ten trades."""
    result = backtest(spark, sf_dir)
    return _rounded_trades(robustness.head_trades(trades_of(result), 10))


_NUMBERED = """num AS (SELECT asset, pnl_points, row_number() OVER (PARTITION BY asset ORDER BY exit_time, entry_time) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM trades)"""
_ENDINGS = """curves AS (SELECT asset, run, trade_no, equity, max(equity) OVER (PARTITION BY asset, run ORDER BY trade_no ROWS UNBOUNDED PRECEDING) - equity AS fall FROM runs),
    ends AS (SELECT asset, run, arg_max(equity, trade_no) AS final, max(fall) AS fall FROM curves GROUP BY 1, 2),
    summary AS (SELECT asset, count(*) AS runs, round(avg(final), 7) AS mean_final, round(quantile_cont(final, 0.05), 7) AS p05_final, round(quantile_cont(final, 0.95), 7) AS p95_final,
        round(-avg(fall), 7) AS mean_max_dd, round(-quantile_cont(fall, 0.95), 7) AS p95_max_dd, round(avg(CASE WHEN final > 0 THEN 1.0 ELSE 0.0 END), 6) AS prob_profitable FROM ends GROUP BY 1)"""
_SHUFFLED = """runs AS (SELECT asset, run, row_number() OVER w AS trade_no, sum(pnl_points) OVER (w ROWS UNBOUNDED PRECEDING) AS equity FROM num, unnest(range(0, 1000)) AS u(run)
    WINDOW w AS (PARTITION BY asset, run ORDER BY md5('42|' || run || '|' || i), i))"""
_BLOCKS = """heads AS (SELECT asset, max(n) AS n, greatest(1, floor(sqrt(max(n))))::BIGINT AS b FROM num GROUP BY 1),
    picks AS (SELECT asset, run, block * b + k + 1 AS trade_no, (('0x' || substr(md5('42|' || run || '|' || block), 1, 8))::BIGINT % n + k) % n AS i
        FROM heads, unnest(range(0, 1000)) AS u(run), unnest(range(0, ceil(n / b)::BIGINT)) AS v(block), unnest(range(0, b)) AS x(k) WHERE block * b + k + 1 <= n),
    runs AS (SELECT p.asset, run, trade_no, sum(pnl_points) OVER (PARTITION BY p.asset, run ORDER BY trade_no ROWS UNBOUNDED PRECEDING) AS equity FROM picks p JOIN num t ON t.asset = p.asset AND t.i = p.i)"""
_SUMMARY = ("mean_final", "p05_final", "p95_final", "mean_max_dd", "p95_max_dd")


def _summary(runs: DataFrame) -> DataFrame:
    s = robustness.monte_carlo_summary(runs)
    return s.select("asset", "runs", *[F.round(c, 7).alias(c) for c in _SUMMARY], F.round("prob_profitable", 6).alias("prob_profitable"))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), _NUMBERED, _SHUFFLED, _ENDINGS, select="SELECT * FROM summary"))
def monte_carlo(spark, sf_dir):
    return _summary(robustness.monte_carlo_trades(trades_of(backtest(spark, sf_dir))))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), _NUMBERED, _BLOCKS, _ENDINGS, select="SELECT * FROM summary"))
def block_bootstrap(spark, sf_dir):
    return _summary(robustness.block_bootstrap_trades(trades_of(backtest(spark, sf_dir))))


@query(o.query(*o.SIGNALS["01"], o.stepper(2.0, 3.0), _NUMBERED, _SHUFFLED, select="SELECT asset, trade_no, round(quantile_cont(equity, 0.05), 7) AS q05, round(quantile_cont(equity, 0.5), 7) AS q50, round(quantile_cont(equity, 0.95), 7) AS q95 FROM runs GROUP BY 1, 2"))
def equity_cone(spark, sf_dir):
    cone = robustness.quantile_cone(robustness.monte_carlo_trades(trades_of(backtest(spark, sf_dir))))
    return cone.select("asset", "trade_no", *[F.round(c, 7).alias(c) for c in ("q05", "q50", "q95")])


_GRID = {"fast": [5, 10], "slow": [30, 50], "sl_atr_mult": [1.5, 2.5], "tp_atr_mult": [2.0, 4.0]}


_WFO = o.walk_forward(_GRID, walkforward.combinations(_GRID), 3, 0.25)
_WFO_NUMBERS = ("is_score", "oos_pnl", "oos_sharpe", "oos_profit_factor", "oos_win_rate", "degradation_ratio")


def _wfo(spark, sf_dir):
    return walkforward.walk_forward(hourly(spark, sf_dir), _GRID, st.SMACrossoverStrategy, 3, 0.25)


@query(o.query(_WFO, select=f"SELECT * REPLACE ({', '.join(f'round({n}, 4) AS {n}' for n in _WFO_NUMBERS)}) FROM wfo"))
def walk_forward_windows(spark, sf_dir):
    windows = _wfo(spark, sf_dir)[0].drop("group", "tf")
    return windows.select(*[F.round(c, 4).alias(c) if c in _WFO_NUMBERS else c for c in windows.columns])


@query(o.query(_WFO, o.stitched(walkforward.combinations(_GRID), 3, 0.25), select='SELECT asset, fold, "timestamp", round(equity, 4) AS equity FROM raised'))
def walk_forward_equity(spark, sf_dir):
    return _wfo(spark, sf_dir)[2].select("asset", "fold", "timestamp", F.round("equity", 4).alias("equity"))


@query(o.query(_WFO, select="""SELECT * FROM (SELECT asset, param_fast, param_slow, param_sl_atr_mult, param_tp_atr_mult, count(*) AS folds, min(fold) AS first_fold FROM wfo GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY asset ORDER BY folds DESC, first_fold) = 1"""))
def walk_forward_params(spark, sf_dir):
    return walkforward.pick_best_params(_wfo(spark, sf_dir)[0]).drop("group", "tf")


_SHORT = {"fast": [5, 10], "slow": [30], "tp_atr_mult": [2.0, 4.0]}


def _wfo_framed(spark, sf_dir):
    """Walk-forward of every series at three timeframes."""
    return walkforward.walk_forward(framed(spark, sf_dir), _SHORT, st.SMACrossoverStrategy, 2, 0.25)


@query()
def walk_forward_combined(spark, sf_dir):
    windows, trades, _ = _wfo_framed(spark, sf_dir)
    return walkforward.combined_windows(windows, trades)


@query(o.query(o.walk_forward(_SHORT, walkforward.combinations(_SHORT), 2, 0.25, o.framed_bars()), select="""SELECT string_split(asset, '@')[1] AS asset, string_split(asset, '@')[2] AS tf, round(avg(oos_sharpe), 4) AS oos_sharpe FROM wfo WHERE oos_sharpe IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY string_split(asset, '@')[1] ORDER BY avg(oos_sharpe) DESC, string_split(asset, '@')[2]) = 1"""))
def walk_forward_best_timeframe(spark, sf_dir):
    return walkforward.best_timeframe(_wfo_framed(spark, sf_dir)[0]).select("asset", "tf", F.round("oos_sharpe", 4).alias("oos_sharpe"))


def _variant(sl: float, tp: float) -> str:
    m = o.query(*o.SIGNALS["01"], o.stepper(sl, tp), o.metrics("asset"), select="SELECT asset, num_trades, total_pnl, win_rate FROM metrics")
    return f"({m})"


@query(" UNION ALL ".join(f"SELECT asset, '{p}' AS param, {v!r}::DOUBLE AS value, num_trades, total_pnl, win_rate FROM {_variant(sl, tp)}" for p, v, sl, tp in (("sl_atr_mult", 1.0, 1.0, 3.0), ("sl_atr_mult", 3.0, 3.0, 3.0), ("tp_atr_mult", 2.0, 2.0, 2.0))))
def sensitivity(spark, sf_dir):
    out = robustness.parameter_sensitivity(hourly(spark, sf_dir), st.SMACrossoverParams(), {"sl_atr_mult": [1.0, 3.0], "tp_atr_mult": [2.0]}, st.SMACrossoverStrategy)
    return out.select("asset", "param", "value", "num_trades", F.round("total_pnl", 4).alias("total_pnl"), F.round("win_rate", 6).alias("win_rate"))


@query(" UNION ALL ".join(f"SELECT 'fast' AS param, {v}::DOUBLE AS value, * FROM ({o.query(*o.sma_signals(v, 50), o.stepper(2.0, 3.0), select='SELECT count(*) AS num_trades, round(sum(pnl_points), 4) AS total_pnl FROM trades')})" for v in (10, 30)))
def sensitivity_joint(spark, sf_dir):
    out = robustness.parameter_sensitivity(hourly(spark, sf_dir), st.SMACrossoverParams(), {"fast": [10, 30]}, st.SMACrossoverStrategy, joint=("group", "tf"))
    return out.select("param", "value", "num_trades", F.round("total_pnl", 4).alias("total_pnl"))


_INSIDE = [*o.START, o.SMA, o.signal_sql("sma_d", o.up("sma_diff"), o.down("sma_diff"), "", session=True)]


def _variants() -> str:
    parts = []
    for name, ctes, session, sizing in (("base", o.SIGNALS["01"], False, "unit"), ("session", _INSIDE, True, "unit"), ("scaled", o.SIGNALS["01"], False, "vol_scaled")):
        select = "SELECT asset, num_trades, total_pnl, (SELECT count(*) FROM trades t WHERE t.asset = m.asset AND reason = 'SESSION_END') AS session_ends FROM metrics m"
        parts.append(f"SELECT '{name}' AS variant, * FROM ({o.query(*ctes, o.stepper(2.0, 3.0, session, sizing), o.metrics('asset'), select=select)})")
    return " UNION ALL ".join(parts)


@query(_variants())
def session_and_sizing_variants(spark, sf_dir):
    p = st.SMACrossoverParams
    chosen = {"base": p(), "session": p(session_start=9, session_end=18), "scaled": p(sizing_mode="vol_scaled")}
    out = compare.variant_metrics(hourly(spark, sf_dir), {n: st.SMACrossoverStrategy(v) for n, v in chosen.items()})
    return out.select("variant", "asset", "num_trades", F.round("total_pnl", 4).alias("total_pnl"), "session_ends")


@query()
def registry_run(spark, sf_dir):
    """All registered strategies over all their timeframes in both groups: events and order prices."""
    events, orders = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    # order dates are days: the order's number within its day gives it a minute of its own
    clock = F.to_timestamp_ntz(F.to_date("o_orderdate").cast("string")) + F.expr("make_dt_interval(0, 9, 0, 0)") + F.expr("make_dt_interval(0, 0, cast(o_orderkey % 540 as int), 0)")
    ticks = {"forex": (events, "event_type", "ts", "value", ("event_id",)), "b3": (orders.withColumn("ts", clock), "o_orderpriority", "ts", "o_totalprice", ("o_orderkey",))}

    # all strategies read the same bars, made once for all timeframes of a group
    needed = {g: [f for reg in compare.STRATEGY_REGISTRY for f in reg.group_timeframes.get(g, ())] for g in ticks}
    bars = {g: staged(ticks_to_frames(source, asset, time, price, needed[g], order, group=g), "registry-bars") for g, (source, asset, time, price, order) in ticks.items()}
    return compare.run_all_strategies(lambda group, frames: bars[group].where(F.col("tf").isin(frames)))[0]


@query()
def synthetic_against_real(spark, sf_dir):
    bars, rules = hourly(spark, sf_dir), Execution()
    made = robustness.synthetic_assets(bars, 2, 300)
    most = 200
    real = run(st.SMACrossoverStrategy().signals(bars), rules)
    by = (*k.KEYS, "copy")
    drawn = run(st.SMACrossoverStrategy(keys=by).signals(made), rules, by)
    first = lambda r, keys: robustness.head_trades(trades_of(r, keys), most, keys)
    return compare.against_real(compute_metrics(first(real, k.KEYS), equity_of(real), p_value=False), compute_metrics(first(drawn, by), equity_of(drawn, by), by, p_value=False))


@query()
def synthetic_series(spark, sf_dir):
    return robustness.synthetic_assets(hourly(spark, sf_dir), 2, 200)


@query()
def classifier_overlay(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return ml.classifier_walk_forward(bars, st.SMACrossoverStrategy, st.SMACrossoverParams(fast=3, slow=8))
