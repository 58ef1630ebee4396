"""Event-driven back-test: one call per series, which works trade by trade instead of bar by bar.

When a position leaves depends on its entry bar alone, never on the running result. So the exits of
all possible entries of a series (bars with a signal and a range) are found together: the first bar
beyond stop or target from blocks of minima and maxima, the next reversed signal and the next end of
a session from sorted positions. What is left in order is to follow the chain from each exit to the
next entry, and the sums over the trades taken.

Position, entry and running result depend on every earlier trade, so a series is one Arrow-grouped
call (grouped by its key, which may include combination and fold). The call returns one row per bar
with the realised equity and the bar's trades (two at most: an exit, and the forced close of an
entry on the last bar); trades and equity are both read from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.kernels import KEYS
from tallyfold.shipping import ship

TRADE = T.StructType([
    T.StructField("entry_time", T.TimestampNTZType()), T.StructField("exit_time", T.TimestampNTZType()), T.StructField("direction", T.IntegerType()),
    T.StructField("entry", T.DoubleType()), T.StructField("exit", T.DoubleType()), T.StructField("reason", T.StringType()),
    T.StructField("pnl_points", T.DoubleType()), T.StructField("bars_held", T.LongType()), T.StructField("size", T.DoubleType()),
])


@dataclass(frozen=True)
class Execution:
    """What the pass needs besides signals. Columns of the same name in the bars take precedence."""

    sl_atr_mult: float = 2.0
    tp_atr_mult: float = 3.0
    session_start: int | None = None
    session_end: int | None = None
    sizing_mode: str = "unit"
    risk_fraction: float = 0.01
    slippage_points: float = 0.0
    initial_capital: float = 10_000.0

    @classmethod
    def of(cls, params, slippage_points: float = 0.0, initial_capital: float = 10_000.0) -> Execution:
        shared = {f: getattr(params, f) for f in ("sl_atr_mult", "tp_atr_mult", "session_start", "session_end", "sizing_mode", "risk_fraction")}
        return cls(**shared, slippage_points=slippage_points, initial_capital=initial_capital)


#: Why a position leaves, in the order in which reasons count on one bar; the last is the series' end.
REASONS = ("SL", "TP", "SIGNAL", "SESSION_END", "EOD")
#: The side of a position and its sizes are kept beside each trade's bars.
_ARROW_TRADE = [("entry_time", pa.timestamp("us")), ("exit_time", pa.timestamp("us")), ("direction", pa.int32()), ("entry", pa.float64()), ("exit", pa.float64()), ("reason", pa.string()), ("pnl_points", pa.float64()), ("bars_held", pa.int64()), ("size", pa.float64())]


class Extremes:
    """Minima of low and maxima of high over aligned blocks of 1, 2, 4, ... bars."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        lows, highs = [low], [high]
        while len(lows[-1]) > 1:
            odd = [np.nan] * (len(lows[-1]) % 2)
            low, high = np.append(lows[-1], odd), np.append(highs[-1], odd)
            # missing values beat nothing
            lows.append(np.fmin(low[::2], low[1::2]))
            highs.append(np.fmax(high[::2], high[1::2]))
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in lows])])[:-1]
        self.low, self.high, self.top = np.concatenate(lows), np.concatenate(highs), len(lows) - 1

    def first(self, start: np.ndarray, stop: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        """First bar from start and before stop with a low of at most below or a high of at least
        above; stop if there is none. Each search climbs to larger blocks while they hold nothing
        and comes down in the first one that does."""
        found, at, level = stop.copy(), start.copy(), np.zeros(len(start), np.int64)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            k, p = level[open_], at[open_]
            block = self.begin[k] + (p >> k)
            hit = (self.low[block] <= below[open_]) | (self.high[block] >= above[open_])
            done = hit & (k == 0)
            found[open_[done]] = p[done]
            p = np.where(hit, p, p + (1 << k))
            k = np.where(hit, k - 1, k + ((((p >> k) & 1) == 0) & (k < self.top)))
            at[open_], level[open_] = p, k
            open_ = open_[~done & (p < stop[open_])]
        return found


@dataclass
class Taken:
    """Trades in order, by bar numbers; reason is a place in REASONS."""

    begin: np.ndarray
    end: np.ndarray
    side: np.ndarray
    entry: np.ndarray
    exit: np.ndarray
    reason: np.ndarray
    size: np.ndarray
    pnl: np.ndarray
    running: np.ndarray


class Series:
    """What all rules share on one series: its prices and where something can happen."""

    def __init__(self, high, low, close, atr, signal, ends):
        self.close, self.atr, self.low, self.high = (np.asarray(x, float) for x in (close, atr, low, high))
        self.n = len(self.close)
        signal = np.asarray(signal)
        self.entries = np.flatnonzero((signal != 0) & ~np.isnan(self.atr))
        self.side = signal[self.entries].astype(np.int64)
        self.extremes = Extremes(self.low, self.high)
        against = [np.append(np.flatnonzero(signal == -s), self.n) for s in (1, -1)]
        after = [x[np.searchsorted(x, self.entries, side="right")] if len(self.entries) else self.entries for x in (*against, np.append(np.flatnonzero(ends), self.n))]
        self.reversal, self.session = np.where(self.side > 0, after[0], after[1]), after[2]

    def exits(self, rules: Execution) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bar, reason and price of the exit of a position opened at each entry."""
        price, reach = self.close[self.entries], self.side * self.atr[self.entries]
        stop, target = price - reach * rules.sl_atr_mult, price + reach * rules.tp_atr_mult
        long = self.side > 0
        last = np.minimum(self.reversal, self.session)
        touched = self.extremes.first(self.entries + 1, np.minimum(last + 1, self.n), np.where(long, stop, target), np.where(long, target, stop))
        level = touched < np.minimum(last + 1, self.n)
        at = np.where(level, touched, last)
        bar = np.minimum(at, self.n - 1)
        stopped = np.where(long, self.low[bar] <= stop, self.high[bar] >= stop)
        reason = np.where(level, np.where(stopped, 0, 1), np.where(at == self.n, 4, np.where(self.reversal <= self.session, 2, 3)))
        return bar, reason, np.where(reason == 0, stop, np.where(reason == 1, target, self.close[bar]))

    def play(self, rules: Execution) -> Taken:
        if not len(self.entries):
            none = np.empty(0, np.int64)
            return Taken(*[none] * 3, *[none.astype(float)] * 2, none, *[none.astype(float)] * 3)
        bar, reason, price = self.exits(rules)
        # the bar of an exit may open the next position
        following = np.searchsorted(self.entries, bar).tolist()
        over, last = (reason == 4).tolist(), len(self.entries)
        chain, i = [], 0
        while i < last:
            chain.append(i)
            i = last if over[i] else following[i]
        taken = np.array(chain)
        begin, side = self.entries[taken], self.side[taken]
        entry, leave, atr = self.close[begin], price[taken], self.atr[begin]
        gain = (leave - entry) * side
        if rules.sizing_mode == "fixed_frac":
            size, running = self._fractions(rules, gain.tolist(), atr.tolist())
        else:
            size = np.where(atr > 0, 1.0 / np.where(atr > 0, atr, 1.0), 1.0) if rules.sizing_mode == "vol_scaled" else np.ones(len(taken))
            running = None
        pnl = gain * size - 2.0 * rules.slippage_points * size
        return Taken(begin, bar[taken], side, entry, leave, reason[taken], size, pnl, np.cumsum(pnl) if running is None else running)

    @staticmethod
    def _fractions(rules: Execution, gain: list[float], atr: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes that risk a share of what has been earned so far, and the running result."""
        total, sizes, totals = 0.0, [], []
        for g, a in zip(gain, atr, strict=True):
            size = (rules.initial_capital + total) * rules.risk_fraction / (rules.sl_atr_mult * a) if a > 0 else 1.0
            total += g * size - 2.0 * rules.slippage_points * size
            sizes.append(size)
            totals.append(total)
        return np.array(sizes), np.array(totals)

    def equity(self, taken: Taken) -> np.ndarray:
        """Realised result at each bar."""
        return np.append(0.0, taken.running)[np.searchsorted(taken.end, np.arange(self.n), side="right")]


def session_ends(times: np.ndarray, start: int | None, end: int | None) -> np.ndarray:
    """Bars inside the session whose next bar is not."""
    if start is None or end is None or not len(times):
        return np.zeros(len(times), bool)
    hour = times.astype("datetime64[h]").astype(np.int64) % 24
    inside = (hour >= start) & (hour < end)
    return inside & ~np.append(inside[1:], False)


def fold(times, high, low, close, atr, signal, ends, rules: Execution) -> tuple[list[float], list[list[tuple]]]:
    """Realised equity and trades of each bar, as lists. ends tells which bars end a session."""
    series = Series(high, low, close, atr, signal, ends)
    taken = series.play(rules)
    trades: list[list[tuple]] = [[] for _ in close]
    for i, (begin, end) in enumerate(zip(taken.begin.tolist(), taken.end.tolist(), strict=True)):
        trades[end].append((times[begin], times[end], int(taken.side[i]), float(taken.entry[i]), float(taken.exit[i]), REASONS[taken.reason[i]], float(taken.pnl[i]), end - begin, float(taken.size[i])))
    return series.equity(taken).tolist(), trades


def numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns as doubles, missing values as nan."""
    return [table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]


def signals_in(table: pa.Table, column: str = "signal") -> np.ndarray:
    return np.nan_to_num(numbers(table, column)[0]).astype(np.int64)


def arrow_trades(times: np.ndarray, taken: Taken) -> pa.ListArray:
    """The trades of each bar as lists of structs."""
    clock = lambda bars: pa.array(times[bars], pa.timestamp("us"))
    values = [clock(taken.begin), clock(taken.end), taken.side.astype(np.int32), taken.entry, taken.exit, pa.array(REASONS).take(pa.array(taken.reason)), taken.pnl, taken.end - taken.begin, taken.size]
    structs = pa.StructArray.from_arrays([pa.array(v, t) if isinstance(v, np.ndarray) else v for v, (_, t) in zip(values, _ARROW_TRADE, strict=True)], fields=[pa.field(n, t) for n, t in _ARROW_TRADE])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(taken.end, minlength=len(times)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def run(signals: DataFrame, rules: Execution | list[Execution], keys=KEYS, measure: Callable[[np.ndarray, Series, Taken], pa.StructScalar] | None = None, measures: T.StructType | None = None) -> DataFrame:
    """keys, ts, equity and trades (array) for each bar of signals (high, low, close, atr, signal).
    Several rules: the column `rule` says which of them a series has. With `measure`, its values
    (fields as in `measures`) are in the column `measured` of each series' last bar."""
    several = isinstance(rules, list)
    varying = ["rule"] if several else [f for f in ("sl_atr_mult", "tp_atr_mult") if f in signals.columns]
    bars = signals.select(*keys, "ts", "high", "low", "close", "atr", "signal", *varying)
    schema = T.StructType([*[bars.schema[c] for c in keys], T.StructField("ts", T.TimestampNTZType()), T.StructField("equity", T.DoubleType()), T.StructField("trades", T.ArrayType(TRADE)), *([T.StructField("measured", measures)] if measure else [])])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        given = {f: table.column(f)[0].as_py() for f in varying}
        own = rules[given["rule"]] if several else replace(rules, **given)
        times = table.column("ts").to_numpy().astype("datetime64[us]")
        series = Series(*numbers(table, "high", "low", "close", "atr"), signals_in(table), session_ends(times, own.session_start, own.session_end))
        taken = series.play(own)
        out = {**{c: table.column(c) for c in keys}, "ts": table.column("ts"), "equity": pa.array(series.equity(taken), pa.float64()), "trades": arrow_trades(times, taken)}
        if measure:
            last = measure(times, series, taken)
            out["measured"] = pa.array([None] * (len(times) - 1) + [last.as_py()], last.type)
        return pa.table(out)

    ship(signals.sparkSession)
    return bars.groupBy(*keys).applyInArrow(one, schema)


def trades_of(result: DataFrame, keys=KEYS) -> DataFrame:
    return result.select(*keys, F.explode("trades").alias("t")).select(*keys, "t.*")


def equity_of(result: DataFrame, keys=KEYS) -> DataFrame:
    return result.select(*keys, F.col("ts").alias("timestamp"), "equity")


@dataclass
class BacktestResult:
    """trades, equity and signals as DataFrames over the same keys, and the parameters."""

    trades: DataFrame
    equity: DataFrame
    signals: DataFrame
    params: dict


class Backtester:
    """Runs a strategy (anything with `params` and `signals(df)`) over long bars."""

    def __init__(self, strategy, slippage_points: float = 0.0, initial_capital: float = 10_000.0):
        self.strategy, self.slippage_points, self.initial_capital = strategy, slippage_points, initial_capital

    def run(self, bars: DataFrame) -> BacktestResult:
        signals = self.strategy.signals(bars)
        keys = getattr(self.strategy, "keys", KEYS)
        result = run(signals, Execution.of(self.strategy.params, self.slippage_points, self.initial_capital), keys)
        return BacktestResult(trades_of(result, keys), equity_of(result, keys), signals, self.strategy.params.as_dict())
