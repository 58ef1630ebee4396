"""SQL twins of the queries, for DuckDB: building blocks as text, put together per query."""

from __future__ import annotations

from tallyfold.functions.rescaled_range import chunk_lengths
from tallyfold.functions.spectrum import cycle_weights, cycles

#: Bars of several lengths in one table; the length is part of the asset's name.
FRAMES = ("30min", "1h", "4h")


def framed_bars(frames: tuple[str, ...] = FRAMES) -> str:
    hours = {f: f"{f.removesuffix('min')} MINUTE" if f.endswith("min") else f"{f[:-1]} HOUR" for f in frames}
    return "bars AS (" + " UNION ALL ".join(
        f"""SELECT event_type || '@{f}' AS asset, time_bucket(INTERVAL {h}, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
           min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS tick_vol FROM events GROUP BY 1, 2""" for f, h in hours.items()) + ")"


BARS = """bars AS (
    SELECT event_type AS asset, time_bucket(INTERVAL 1 HOUR, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
           min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS tick_vol
    FROM events GROUP BY 1, 2)"""


def rows(n: int, key: str = "asset") -> str:
    return f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int, key: str = "asset", order: str = "ts") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def full(agg: str, x: str, n: int, frame: str | None = None) -> str:
    frame = frame or rows(n)
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY asset ORDER BY ts)"


def up(x: str, level: str = "0") -> str:
    return f"coalesce({x} > {level} AND {lag(x)} <= {level}, false)"


def down(x: str, level: str = "0") -> str:
    return f"coalesce({x} < {level} AND {lag(x)} >= {level}, false)"


def query(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


TR = f"""tr_ AS (SELECT *, greatest(high - low, abs(high - {lag("close")}), abs(low - {lag("close")})) AS tr FROM bars)"""


def atr(n: int = 14, source: str = "tr_", out: str = "base") -> str:
    return f"{out} AS (SELECT *, {full('avg', 'tr', n)} AS atr, row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn FROM {source})"


START = (BARS, TR, atr())


def ewm(name: str, source: str, x: str, alpha: float, least: int, out: str | None = None) -> list[str]:
    """CTE `name`: source plus the exponential average of x, in closed form: each value weighs
    alpha * (1 - alpha) ** age, the first one (1 - alpha) ** age."""
    out = out or name
    return [
        f"{name}_v AS (SELECT asset, rn, {x} AS x, row_number() OVER (PARTITION BY asset ORDER BY rn) AS k FROM {source} WHERE {x} IS NOT NULL)",
        f"""{name}_s AS (SELECT a.asset, a.rn, sum(b.x * pow(1 - {alpha!r}, a.k - b.k) * CASE WHEN b.k = 1 THEN 1 ELSE {alpha!r} END) AS y, max(a.k) AS k
            FROM {name}_v a JOIN {name}_v b ON a.asset = b.asset AND b.k <= a.k GROUP BY 1, 2)""",
        f"{name} AS (SELECT s.*, CASE WHEN e.k >= {least} THEN e.y END AS {out}_ FROM {source} s LEFT JOIN {name}_s e ON e.asset = s.asset AND e.rn = s.rn)",
    ]


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def moves(source: str = "base") -> str:
    d = f"close - {lag('close')}"
    return f"moved AS (SELECT *, CASE WHEN {d} IS NOT NULL THEN greatest({d}, 0) END AS gain, CASE WHEN {d} IS NOT NULL THEN greatest(-({d}), 0) END AS loss FROM {source})"


def rsi(n: int, source: str = "base") -> list[str]:
    return [
        moves(source), *ewm("ga", "moved", "gain", 1.0 / n, n), *ewm("la", "ga", "loss", 1.0 / n, n),
        "rsi_t AS (SELECT *, CASE WHEN la_ > 0 THEN 100 - 100 / (1 + ga_ / la_) WHEN ga_ > 0 THEN 100 END AS rsi FROM la)",
    ]


def adx(n: int, source: str = "base") -> list[str]:
    u, d = f"(high - {lag('high')})", f"({lag('low')} - low)"
    return [
        f"dm AS (SELECT *, CASE WHEN {u} > {d} AND {u} > 0 THEN {u} ELSE 0 END AS dmu, CASE WHEN {d} > {u} AND {d} > 0 THEN {d} ELSE 0 END AS dmd FROM {source})",
        *ewm("du", "dm", "dmu", 1.0 / n, n), *ewm("dd", "du", "dmd", 1.0 / n, n), *ewm("dt", "dd", "tr", 1.0 / n, n),
        "dx_t AS (SELECT *, CASE WHEN du_ + dd_ > 0 THEN 100 * abs(du_ - dd_) / (du_ + dd_) END AS dx FROM dt)",
        *ewm("ax", "dx_t", "dx", 1.0 / n, n), "adx_t AS (SELECT *, ax_ AS adx FROM ax)",
    ]


SMA = f"sma_t AS (SELECT *, {full('avg', 'close', 20)} AS sma_fast, {full('avg', 'close', 50)} AS sma_slow FROM base), sma_d AS (SELECT *, sma_fast - sma_slow AS sma_diff FROM sma_t)"


def sma_signals(fast: int, slow: int, start: tuple[str, ...] = START) -> list[str]:
    averages = f"sma_t AS (SELECT *, {full('avg', 'close', fast)} AS sma_fast, {full('avg', 'close', slow)} AS sma_slow FROM base), sma_d AS (SELECT *, sma_fast - sma_slow AS sma_diff FROM sma_t)"
    return [*start, averages, signal_sql("sma_d", up("sma_diff"), down("sma_diff"), "")]


BOLLINGER = f"""bb_1 AS (SELECT *, {full('avg', 'close', 20)} AS bb_mid, 2 * {full('stddev_samp', 'close', 20)} AS dev FROM base),
    bb_2 AS (SELECT *, bb_mid + dev AS bb_upper, bb_mid - dev AS bb_lower, (bb_mid + dev - (bb_mid - dev)) / bb_mid AS bb_width FROM bb_1),
    bb AS (SELECT *, coalesce((bb_width <= {full('min', 'bb_width', 20)})::INTEGER, 0) AS squeeze FROM bb_2)"""
DONCHIAN = f"""dc_1 AS (SELECT *, {full('max', 'high', 20, prior(20))} AS eh, {full('min', 'low', 20, prior(20))} AS el,
        {full('max', 'high', 10, prior(10))} AS xh, {full('min', 'low', 10, prior(10))} AS xl FROM base),
    dc_2 AS (SELECT *, CASE WHEN close > eh THEN 1 WHEN close < el THEN -1 END AS mark FROM dc_1),
    dc AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS trend FROM dc_2)"""
STOCHASTIC = f"""st_1 AS (SELECT *, {full('min', 'low', 14)} AS ll, {full('max', 'high', 14)} AS hh FROM base),
    st_2 AS (SELECT *, CASE WHEN hh - ll <> 0 THEN 100 * (close - ll) / (hh - ll) ELSE 50.0 END AS stoch_k FROM st_1),
    st AS (SELECT *, {full('avg', 'stoch_k', 3)} AS stoch_d FROM st_2)"""
INSIDE = "(hour(ts) >= 9 AND hour(ts) < 18)"
_DAY = "(PARTITION BY asset, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING)"
VWAP = f"""vw_1 AS (SELECT *, CASE WHEN {INSIDE} THEN CASE WHEN tick_vol > 0 THEN tick_vol ELSE 1 END END AS w, (high + low + close) / 3 AS tp FROM base),
    vw_2 AS (SELECT *, sum(w) OVER {_DAY} AS sw, sum(w * tp) OVER {_DAY} AS sp, sum(w * tp * tp) OVER {_DAY} AS spp, count(w) OVER {_DAY} AS session_bar FROM vw_1),
    vw AS (SELECT *, CASE WHEN {INSIDE} THEN sp / sw END AS vwap, CASE WHEN {INSIDE} THEN sqrt(greatest(0, spp / sw - (sp / sw) * (sp / sw))) END AS vwap_sigma FROM vw_2)"""
DUAL_THRUST = f"""dth_1 AS (SELECT asset, ts::DATE AS day, arg_min(open, ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars WHERE {INSIDE} GROUP BY 1, 2),
    dth_2 AS (SELECT *, greatest({full('max', 'h', 4, prior(4, 'asset', 'day'))} - {full('min', 'c', 4, prior(4, 'asset', 'day'))},
        {full('max', 'c', 4, prior(4, 'asset', 'day'))} - {full('min', 'l', 4, prior(4, 'asset', 'day'))}) AS spread FROM dth_1),
    dth AS (SELECT b.*, d.o + 0.5 * d.spread AS upper_trigger, d.o - 0.5 * d.spread AS lower_trigger FROM base b LEFT JOIN dth_2 d ON d.asset = b.asset AND d.day = b.ts::DATE)"""


def ols(n: int = 50, mult: float = 2.0) -> str:
    stat = lambda f: f"CASE WHEN count(close) OVER {rows(n)} = {n} THEN {f}(close, rn::DOUBLE) OVER {rows(n)} END"
    return f"""ols_1 AS (SELECT *, {stat('regr_slope')} AS ols_slope, {stat('regr_avgy')} AS my, {stat('regr_sxy')} AS sxy, {stat('regr_syy')} AS syy FROM base),
    ols_2 AS (SELECT *, my + ols_slope * {(n - 1) / 2.0} AS ols_line, sqrt(greatest(0, syy - ols_slope * sxy) / {n - 2}) AS ols_se FROM ols_1),
    ols AS (SELECT *, ols_line + {mult} * ols_se AS ols_upper, ols_line - {mult} * ols_se AS ols_lower, ols_slope * {n} / nullif(atr, 0) AS slope_norm FROM ols_2)"""


def fft(n: int, shortest: int, longest: int) -> str:
    weights = ", ".join(repr(float(w)) for w in cycle_weights(n, shortest, longest))
    return f"""fft AS (SELECT *, CASE WHEN count(close) OVER {rows(n)} = {n}
        THEN list_dot_product(list(ln(close)) OVER {rows(n)}, [{weights}]::DOUBLE[]) END AS fft_delta FROM base)"""


def _weights(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def harmonics(n: int, shortest: int, longest: int, most: int, floor: float) -> str:
    """The projection from each frequency's coefficient, as sums over the window."""
    c = cycles(n, shortest, longest)
    first = c.band.start
    waves = range(c.transform.shape[1])
    part = lambda f: ", ".join(f"list_dot_product(w, {_weights(getattr(c.transform[:, k], f))})" for k in waves)
    inside = f"[{first + 1}:{min(c.band.stop, len(waves))}]"
    return f"""hm_1 AS (SELECT *, CASE WHEN count(close) OVER {rows(n)} = {n} THEN list(ln(close)) OVER {rows(n)} END AS w FROM base),
    hm_2 AS (SELECT asset, ts, w, [{part('real')}] AS re, [{part('imag')}] AS im FROM hm_1 WHERE w IS NOT NULL),
    hm_3 AS (SELECT *, list_transform(list_zip(re, im), lambda z: z[1] * z[1] + z[2] * z[2]) AS power,
        list_transform(list_zip(re, im, {_weights(c.turn.real)}, {_weights(c.turn.imag)}), lambda z: z[1] * z[3] - z[2] * z[4]) AS step FROM hm_2),
    hm_4 AS (SELECT *, list_sort(list_transform(list_zip(power{inside}, step{inside}, range({min(c.band.stop, len(waves)) - first})), lambda z: {{'p': -z[1], 'k': z[3], 's': z[2]}}))[1:{most}] AS best FROM hm_3),
    fft AS (SELECT b.*, CASE WHEN list_min(w) < list_max(w) AND list_sum(power{inside}) >= {floor!r} * list_sum(power)
        THEN list_sum(list_transform(best, lambda z: z.s)) + list_dot_product(w, {_weights(c.slope)}) END AS fft_delta FROM base b LEFT JOIN hm_4 h ON h.asset = b.asset AND h.ts = b.ts)"""


def hurst(window: int, least: int, step: int) -> list[str]:
    """CTEs up to hurst_t: base with the exponent of the last log returns, every `step` bars."""
    lengths = ", ".join(map(str, chunk_lengths(window, least)))
    return [
        f"hu_r AS (SELECT *, rn - 1 AS i, ln(close) - ln({lag('close')}) AS r FROM base)",
        f"hu_e AS (SELECT asset, i AS e FROM hu_r WHERE i >= {window} AND (i - {window}) % {step} = 0)",
        f"hu_w AS (SELECT h.asset, e, i - e + {window - 1} AS k, r FROM hu_e h JOIN hu_r x ON x.asset = h.asset AND x.i BETWEEN h.e - {window - 1} AND h.e)",
        f"hu_c AS (SELECT asset, e, s, k // s AS c, k, r, avg(r) OVER (PARTITION BY asset, e, s, k // s) AS m FROM hu_w, unnest([{lengths}]) AS u(s) WHERE k < {window} // s * s)",
        "hu_d AS (SELECT *, sum(r - m) OVER (PARTITION BY asset, e, s, c ORDER BY k) AS d FROM hu_c)",
        "hu_q AS (SELECT asset, e, s, c, (max(d) - min(d)) / nullif(stddev_pop(r), 0) AS q FROM hu_d GROUP BY ALL)",
        "hu_p AS (SELECT asset, e, s, ln(avg(q)) AS y FROM hu_q GROUP BY ALL)",
        "hu_s AS (SELECT asset, e, CASE WHEN count(y) > 1 THEN regr_slope(y, ln(s)) END AS h FROM hu_p GROUP BY ALL)",
        "hurst_t AS (SELECT b.*, last_value(h IGNORE NULLS) OVER (PARTITION BY b.asset ORDER BY b.rn ROWS UNBOUNDED PRECEDING) AS hurst FROM base b LEFT JOIN hu_s s ON s.asset = b.asset AND s.e = b.rn - 1)",
    ]


def signal_sql(source: str, long: str, short: str, guard: str = "atr", gate: str = "true", session: bool = False) -> str:
    """CTE sig: asset, ts, prices, atr and signal."""
    missing = " OR ".join(f"{g.strip()} IS NULL" for g in guard.split(",")) if guard else "false"
    inside = f"AND {INSIDE}" if session else ""
    return f"""flags AS (SELECT *, coalesce({long}, false) AS is_long, coalesce({short}, false) AS is_short, coalesce({gate}, false) AS allowed FROM {source}),
    sig AS (SELECT asset, ts, high, low, close, atr, CASE WHEN {missing} THEN 0 WHEN allowed {inside} AND is_long THEN 1 WHEN allowed {inside} AND is_short THEN -1 ELSE 0 END AS signal FROM flags)"""


_TIGHT = f"(coalesce({lag('squeeze')}, 0) > 0 OR coalesce({lag('squeeze', 2)}, 0) > 0)"
_CUT = f"({INSIDE} AND hour(ts) * 60 + minute(ts) < 18 * 60 - 30)"
_E = ["e1_", "e2_", "e3_", "e4_"]
_RIBBON = f"ribbon AS (SELECT *, coalesce(e1_ > e2_ AND e2_ > e3_ AND e3_ > e4_, false) AS bull, coalesce(e1_ < e2_ AND e2_ < e3_ AND e3_ < e4_, false) AS bear FROM rsi_t)"

EMAS = [x for i, n in enumerate((5, 8, 13, 21), 1) for x in ewm(f"e{i}", "base" if i == 1 else f"e{i - 1}", "close", span(n), n)]
MACD = [
    *ewm("f", "base", "close", span(12), 12), *ewm("s", "f", "close", span(26), 26), "md AS (SELECT *, f_ - s_ AS macd FROM s)",
    *ewm("g", "md", "macd", span(9), 9), "macd_t AS (SELECT *, g_ AS macd_signal, macd - g_ AS macd_hist FROM g)",
]
KELTNER = [*adx(14), *ewm("km", "adx_t", "close", span(20), 20), f"kc_1 AS (SELECT *, km_ AS kc_mid, {full('avg', 'tr', 10)} AS kc_atr FROM km)", "kc AS (SELECT *, kc_mid + 2 * kc_atr AS kc_upper, kc_mid - 2 * kc_atr AS kc_lower FROM kc_1)"]

#: CTEs up to `sig`, by strategy number.
SIGNALS: dict[str, list[str]] = {
    "01": [*START, SMA, signal_sql("sma_d", up("sma_diff"), down("sma_diff"), "")],
    "02": [*START, *rsi(14), signal_sql("rsi_t", up("rsi", "30"), down("rsi", "70"), "atr, rsi")],
    "03": [*START, BOLLINGER, signal_sql("bb", f"close > bb_upper AND {_TIGHT}", f"close < bb_lower AND {_TIGHT}", "atr, bb_upper, bb_lower")],
    "04": [*START, *MACD, signal_sql("macd_t", up("macd_hist"), down("macd_hist"), "atr, macd_hist")],
    "05": [*START, DONCHIAN, signal_sql("dc", f"coalesce(close > eh, false) OR coalesce(close > xh AND coalesce({lag('trend')}, 0) = -1, false)", f"coalesce(close < el, false) OR coalesce(close < xl AND coalesce({lag('trend')}, 0) = 1, false)", "atr, eh, el")],
    "06": [*START, *EMAS, *rsi(14, "e4"), _RIBBON, signal_sql("ribbon", f"bull AND NOT coalesce({lag('bull')}, false) AND rsi < 65", f"bear AND NOT coalesce({lag('bear')}, false) AND rsi > 35", "atr, e4_, rsi")],
    "07": [*START, *KELTNER, signal_sql("kc", "close <= kc_lower", "close >= kc_upper", "atr, kc_upper, kc_lower", "adx < 25")],
    "08": [*START, *hurst(128, 8, 4), *rsi(14, "hurst_t"), "h_t AS (SELECT * FROM rsi_t)", SMA.replace("FROM base", "FROM h_t"), signal_sql("sma_d",
        f"coalesce(hurst > 0.6 AND {up('sma_diff')}, false) OR coalesce(hurst < 0.4 AND {up('rsi', '30')}, false)",
        f"coalesce(hurst > 0.6 AND {down('sma_diff')}, false) OR coalesce(hurst < 0.4 AND {down('rsi', '70')}, false)", "atr, hurst, sma_slow, rsi")],
    "09": [*START, DUAL_THRUST, signal_sql("dth", f"close > upper_trigger AND {_CUT}", f"close < lower_trigger AND {_CUT}", "atr, upper_trigger, lower_trigger", session=True)],
    "11": [*START, VWAP, signal_sql("vw", f"close <= vwap - 1.0 * vwap_sigma AND {_CUT} AND session_bar >= 3 AND vwap_sigma > 0", f"close >= vwap + 1.0 * vwap_sigma AND {_CUT} AND session_bar >= 3 AND vwap_sigma > 0", "atr, vwap", session=True)],
    "12": [*START, STOCHASTIC, signal_sql("st", up("stoch_k", "20"), down("stoch_k", "80"), "atr, stoch_k")],
    "13": [*START, ols(), signal_sql("ols",
        f"coalesce(abs(slope_norm) >= 0.3 AND slope_norm > 0 AND close > ols_upper AND {lag('close')} <= {lag('ols_upper')}, false) OR coalesce(abs(slope_norm) < 0.3 AND close <= ols_lower, false)",
        f"coalesce(abs(slope_norm) >= 0.3 AND slope_norm < 0 AND close < ols_lower AND {lag('close')} >= {lag('ols_lower')}, false) OR coalesce(abs(slope_norm) < 0.3 AND close >= ols_upper, false)", "atr, ols_line, slope_norm")],
    "14": [*START, fft(32, 4, 12), signal_sql("fft", f"fft_delta > 0.1 * atr / close AND {lag('fft_delta')} <= 0", f"fft_delta < -0.1 * atr / close AND {lag('fft_delta')} >= 0", "atr, fft_delta")],
}


def stepper(sl: float, tp: float, session: bool = False, sizing: str = "unit", slippage: float = 0.0, sig: str = "sig", keys: str = "asset") -> str:
    """CTEs numbered, steps, trades, equity: one bar per recursion step. Keys other than asset are
    columns of sig as well."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"b.{k} = s.{k}" for k in names)
    bk = ", ".join(f"b.{k}" for k in names)
    size = {"unit": "1.0", "vol_scaled": "CASE WHEN atr > 0 THEN 1.0 / atr ELSE 1.0 END", "fixed_frac": f"CASE WHEN atr > 0 THEN (10000.0 + run2) * 0.01 / ({sl} * atr) ELSE 1.0 END"}[sizing]
    ends = f"{INSIDE} AND NOT coalesce(lead({INSIDE}) OVER (PARTITION BY {keys} ORDER BY ts), false)" if session else "false"
    return f"""numbered AS (SELECT {keys}, ts, high, low, close, atr, signal, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS i, count(*) OVER (PARTITION BY {keys}) AS n, {ends} AS ends FROM {sig}),
    steps AS (
        SELECT DISTINCT {keys}, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 0 AS pos, 1.0::DOUBLE AS size, 0.0::DOUBLE AS entry, NULL::TIMESTAMP AS entry_ts, 0::BIGINT AS entry_i,
            0.0::DOUBLE AS sl, 0.0::DOUBLE AS tp, 0.0::DOUBLE AS running, NULL::VARCHAR AS reason, 0.0::DOUBLE AS price, 0.0::DOUBLE AS pnl, 0 AS was, 0.0::DOUBLE AS was_entry, NULL::TIMESTAMP AS was_ts, 0::BIGINT AS was_i, 1.0::DOUBLE AS was_size, 0.0::DOUBLE AS close, 0::BIGINT AS n FROM numbered
        UNION ALL
        SELECT {keys}, bi, bts, CASE WHEN opens THEN signal ELSE pos2 END, CASE WHEN opens THEN {size} ELSE size END, CASE WHEN opens THEN bclose ELSE entry END, CASE WHEN opens THEN bts ELSE entry_ts END, CASE WHEN opens THEN bi ELSE entry_i END,
            CASE WHEN opens THEN bclose - signal * {sl} * atr ELSE sl END, CASE WHEN opens THEN bclose + signal * {tp} * atr ELSE tp END,
            run2, why, at_price, gain, pos, entry, entry_ts, entry_i, size, bclose, bn
        FROM (SELECT *, running + coalesce(gain, 0) AS run2, CASE WHEN why IS NULL THEN pos ELSE 0 END AS pos2, ((pos = 0 OR why IS NOT NULL) AND signal <> 0 AND atr IS NOT NULL) AS opens
        FROM (SELECT *, CASE WHEN why IS NOT NULL THEN (at_price - entry) * pos * size - 2 * {slippage} * size END AS gain
        FROM (SELECT *, CASE why WHEN 'SL' THEN sl WHEN 'TP' THEN tp ELSE bclose END AS at_price
        FROM (SELECT {bk}, s.pos, s.size, s.entry, s.entry_ts, s.entry_i, s.sl, s.tp, s.running, b.i AS bi, b.ts AS bts, b.close AS bclose, b.n AS bn, b.signal, b.atr,
            CASE WHEN s.pos = 0 THEN NULL WHEN (s.pos > 0 AND b.low <= s.sl) OR (s.pos < 0 AND b.high >= s.sl) THEN 'SL'
                 WHEN (s.pos > 0 AND b.high >= s.tp) OR (s.pos < 0 AND b.low <= s.tp) THEN 'TP'
                 WHEN b.signal = -s.pos THEN 'SIGNAL' WHEN b.ends THEN 'SESSION_END' END AS why
        FROM steps s JOIN numbered b ON {same} AND b.i = s.i + 1))))),
    trades AS (
        SELECT {keys}, was_ts AS entry_time, ts AS exit_time, was AS direction, was_entry AS entry, price AS "exit", reason, pnl AS pnl_points, i - was_i AS bars_held, was_size AS size FROM steps WHERE reason IS NOT NULL
        UNION ALL
        SELECT {keys}, entry_ts, ts, pos, entry, close, 'EOD', (close - entry) * pos * size - 2 * {slippage} * size, i - entry_i, size FROM steps WHERE i = n AND i > 0 AND pos <> 0),
    equity AS (
        SELECT {keys}, ts AS "timestamp", running + CASE WHEN i = n AND pos <> 0 THEN (close - entry) * pos * size - 2 * {slippage} * size ELSE 0 END AS equity FROM steps WHERE i > 0)"""


def daily(keys: str, source: str = "equity") -> str:
    return f"""days AS (SELECT {keys}, "timestamp"::DATE AS day, arg_max(equity, "timestamp") AS equity FROM {source} GROUP BY ALL),
    bounds AS (SELECT {keys}, min(day) AS lo, max(day) AS hi FROM days GROUP BY ALL),
    calendar AS (SELECT {keys}, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM bounds),
    filled AS (SELECT {keys}, day, last_value(d.equity IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM calendar c LEFT JOIN days d USING ({keys}, day)),
    changes AS (SELECT * FROM (SELECT {keys}, day, equity - lag(equity) OVER (PARTITION BY {keys} ORDER BY day) AS daily_return FROM filled) WHERE daily_return IS NOT NULL)"""


def metrics(keys: str, trades: str = "trades", equity: str = "equity") -> str:
    """CTE metrics over trades and equity, for keys that have trades; empty keys get defaults."""
    by = f"PARTITION BY {keys}"
    return f"""{daily(keys, equity)},
    base_m AS (SELECT {keys}, count(*) AS num_trades, sum(pnl_points) AS total_pnl, avg(CASE WHEN pnl_points > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
        avg(CASE WHEN pnl_points > 0 THEN pnl_points END) AS avg_win, avg(CASE WHEN pnl_points < 0 THEN pnl_points END) AS avg_loss,
        CASE WHEN sum(CASE WHEN pnl_points < 0 THEN pnl_points END) < 0 THEN coalesce(sum(CASE WHEN pnl_points > 0 THEN pnl_points END), 0) / abs(sum(CASE WHEN pnl_points < 0 THEN pnl_points END))
             WHEN sum(CASE WHEN pnl_points > 0 THEN pnl_points END) > 0 THEN 'inf'::DOUBLE END AS profit_factor,
        avg(pnl_points) AS expectancy, CASE WHEN count(*) > 1 THEN stddev_samp(pnl_points) END AS sd FROM {trades} GROUP BY ALL),
    run_1 AS (SELECT {keys}, pnl_points < 0 AS lost, row_number() OVER ({by} ORDER BY exit_time, entry_time) AS i FROM {trades}),
    run_2 AS (SELECT {keys}, lost, i - row_number() OVER (PARTITION BY {keys}, lost ORDER BY i) AS island FROM run_1),
    runs_m AS (SELECT {keys}, max(c) AS streak FROM (SELECT {keys}, island, count(*) AS c FROM run_2 WHERE lost GROUP BY ALL) GROUP BY ALL),
    depth AS (SELECT {keys}, min(d) AS deep FROM (SELECT {keys}, equity - max(equity) OVER ({by} ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS d FROM {equity}) GROUP BY ALL),
    sharpe AS (SELECT {keys}, CASE WHEN count(*) > 1 AND stddev_samp(daily_return) > 0 THEN avg(daily_return) / stddev_samp(daily_return) * sqrt(252) END AS ratio FROM changes GROUP BY ALL),
    metrics AS (SELECT {keys}, num_trades, round(total_pnl, 4) AS total_pnl, round(win_rate, 6) AS win_rate, round(avg_win, 4) AS avg_win, round(avg_loss, 4) AS avg_loss, round(profit_factor, 6) AS profit_factor,
        round(expectancy, 4) AS expectancy, round(coalesce(deep, 0), 4) AS max_drawdown, coalesce(streak, 0) AS max_consec_losses, round(ratio, 5) AS sharpe_daily,
        round(CASE WHEN sd > 0 THEN expectancy / (sd / sqrt(num_trades)) END, 5) AS t_stat FROM base_m LEFT JOIN runs_m USING ({keys}) LEFT JOIN depth USING ({keys}) LEFT JOIN sharpe USING ({keys}))"""


TRADE_COLUMNS = 'entry_time, exit_time, direction, round(entry, 6) AS entry, round("exit", 6) AS "exit", reason, round(pnl_points, 6) AS pnl_points, bars_held, round(size, 6) AS size'


def folds(n_splits: int, oos_ratio: float, bars: str = BARS) -> str:
    """CTE cut: bars with fold, segment and `series` (asset, fold and segment in one)."""
    return bars.replace("bars AS", "hours AS", 1) + f""",
    counted AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM hours),
    parted AS (SELECT *, least(i // greatest(n // {n_splits}, 1), {n_splits - 1}) AS fold FROM counted),
    placed AS (SELECT *, row_number() OVER (PARTITION BY asset, fold ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY asset, fold) AS m FROM parted),
    cut AS (SELECT *, CASE WHEN k < greatest(1, floor(m * {1.0 - oos_ratio!r}::DOUBLE)) THEN 'is' ELSE 'oos' END AS segment FROM placed WHERE m >= 50 AND greatest(1, floor(m * {1.0 - oos_ratio!r}::DOUBLE)) < m)"""


def fold_results(combos: list[dict], n_splits: int, oos_ratio: float, source: str = BARS) -> str:
    """Per series of folds() and combination (the last one stands for the class defaults): metrics."""
    wanted = "asset, num_trades, total_pnl, win_rate, profit_factor, ratio AS sharpe, CASE WHEN sd > 0 THEN b.expectancy / (sd / sqrt(num_trades)) END AS t"
    return fold_parts(combos, n_splits, oos_ratio, source, f"SELECT {wanted} FROM base_m b LEFT JOIN sharpe USING (asset)", metrics("asset"))


def fold_parts(combos: list[dict], n_splits: int, oos_ratio: float, source: str, select: str, *more: str) -> str:
    bars = "bars AS (SELECT asset || '|' || fold || '|' || segment AS asset, ts, open, high, low, close, tick_vol FROM cut)"
    parts = []
    for i, c in enumerate([*combos, {}]):
        ctes = [folds(n_splits, oos_ratio, source), *sma_signals(c.get("fast", 20), c.get("slow", 50), (bars, TR, atr())), stepper(c.get("sl_atr_mult", 2.0), c.get("tp_atr_mult", 3.0)), *more]
        parts.append(f"SELECT {i} AS combo, * FROM ({query(*ctes, select=select)})")
    return " UNION ALL ".join(parts)


def walk_forward(grid: dict[str, list], combos: list[dict], n_splits: int, oos_ratio: float, source: str = BARS) -> str:
    """CTEs up to wfo: one row per asset and fold."""
    values = ", ".join(str((i, *[str(c.get(n, {"fast": 20, "slow": 50, "sl_atr_mult": 2.0, "tp_atr_mult": 3.0}[n])) for n in grid])) for i, c in enumerate([*combos, {}]))
    limits = ", ".join(f"{f}(ts) FILTER (segment = '{s}') AS {s}_{n}" for s in ("is", "oos") for f, n in (("min", "start"), ("max", "end")))
    names = ", ".join(f"param_{n}" for n in grid)
    return f"""{folds(n_splits, oos_ratio, source)},
    results AS MATERIALIZED (SELECT combo, num_trades, total_pnl, win_rate, profit_factor, sharpe, CASE WHEN num_trades >= 5 THEN coalesce(sharpe, t) END AS score,
        string_split(asset, '|')[1] AS asset, string_split(asset, '|')[2]::INTEGER AS fold, string_split(asset, '|')[3] AS segment FROM ({fold_results(combos, n_splits, oos_ratio, source)})),
    limits AS (SELECT asset, fold::INTEGER AS fold, {limits} FROM cut GROUP BY 1, 2),
    best AS (SELECT asset, fold, combo, score FROM results WHERE segment = 'is' AND combo < {len(combos)} AND score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY asset, fold ORDER BY score DESC, combo) = 1),
    given(combo, {names}) AS (VALUES {values}),
    wfo AS (SELECT l.asset, l.fold, is_start, is_end, oos_start, oos_end, b.score AS is_score, coalesce(r.total_pnl, 0) AS oos_pnl, r.sharpe AS oos_sharpe, r.profit_factor AS oos_profit_factor,
        r.win_rate AS oos_win_rate, coalesce(r.num_trades, 0) AS oos_trades, CASE WHEN b.score > 0 THEN r.sharpe / b.score END AS degradation_ratio, {names}
        FROM limits l LEFT JOIN best b ON b.asset = l.asset AND b.fold = l.fold
        LEFT JOIN results r ON r.asset = l.asset AND r.fold = l.fold AND r.segment = 'oos' AND r.combo = coalesce(b.combo, {len(combos)})
        JOIN given g ON g.combo = coalesce(b.combo, {len(combos)}))"""


def stitched(combos: list[dict], n_splits: int, oos_ratio: float) -> str:
    """CTEs after walk_forward(): equity of the chosen combinations, each fold raised by those before."""
    return f"""curves AS MATERIALIZED (SELECT combo, "timestamp", equity, string_split(asset, '|')[1] AS asset, string_split(asset, '|')[2]::INTEGER AS fold, string_split(asset, '|')[3] AS segment
        FROM ({fold_parts(combos, n_splits, oos_ratio, BARS, 'SELECT * FROM equity')})),
    picked AS (SELECT c.asset, c.fold, "timestamp", equity FROM curves c JOIN limits l ON l.asset = c.asset AND l.fold = c.fold LEFT JOIN best b ON b.asset = c.asset AND b.fold = c.fold
        WHERE segment = 'oos' AND c.combo = coalesce(b.combo, {len(combos)})),
    finals AS (SELECT asset, fold, arg_max(equity, "timestamp") AS final FROM picked GROUP BY 1, 2),
    raised AS (SELECT p.asset, p.fold, "timestamp", equity + coalesce((SELECT sum(final) FROM finals f WHERE f.asset = p.asset AND f.fold < p.fold), 0) AS equity FROM picked p)"""
