"""The back-test over a stream of bars with signals: one state per series.

The state is the open position (side, size, entry, stop and target), the running result, and the
bars that can't be judged yet. Bars are judged in order of event time: those that arrive wait until
the watermark has passed them, so a bar that is late by less than `lateness` takes its place. A bar
that arrives behind the watermark (of all series), or again, is left out.
Whether a bar ends a session depends on the next one, so the newest passed bar waits for another.

A row without a close ends its series: all bars that wait are judged, a position still open leaves
at the last close (EOD), and the state is given up. Trades come out as their exits are judged; they
are those of the batch form over the same bars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.kernels import KEYS
from tallyfold.operators.backtest import TRADE, Execution
from tallyfold.shipping import ship

_NUMBERS = ("high", "low", "close", "atr")


@dataclass
class Held:
    """What is known of a series between two bars; times are microseconds. side 0: no position.
    bars counts judged ones, begin is the count at the entry."""

    running: float = 0.0
    side: int = 0
    size: float = 1.0
    price: float = 0.0
    stop: float = 0.0
    target: float = 0.0
    entered: int = 0
    begin: int = 0
    bars: int = 0
    last: int = -(1 << 62)
    last_close: float = 0.0


def _passes(held: Held, high: float, low: float, close: float, signal: int, ends: bool) -> tuple[str, float] | None:
    """Why and where the position leaves on this bar."""
    beyond, reached = (low <= held.stop, high >= held.target) if held.side > 0 else (high >= held.stop, low <= held.target)
    for reason, happens, price in (("SL", beyond, held.stop), ("TP", reached, held.target), ("SIGNAL", signal == -held.side, close), ("SESSION_END", ends, close)):
        if happens:
            return reason, price
    return None


def _close(held: Held, at: int, reason: str, price: float, rules: Execution) -> tuple:
    gain = (price - held.price) * held.side * held.size - 2.0 * rules.slippage_points * held.size
    held.running += gain
    trade = (held.entered, at, held.side, held.price, price, reason, gain, held.bars - held.begin, held.size)
    held.side = 0
    return trade


def judge(held: Held, at: int, high: float, low: float, close: float, atr: float, signal: int, ends: bool, rules: Execution) -> tuple | None:
    """One bar: changes held, and gives the trade that it closes."""
    trade = None
    if held.side and (leave := _passes(held, high, low, close, signal, ends)):
        trade = _close(held, at, *leave, rules)
    if not held.side and signal and not math.isnan(atr):
        size = 1.0
        if atr > 0 and rules.sizing_mode == "vol_scaled":
            size = 1.0 / atr
        elif atr > 0 and rules.sizing_mode == "fixed_frac":
            size = (rules.initial_capital + held.running) * rules.risk_fraction / (rules.sl_atr_mult * atr)
        held.side, held.size, held.price, held.entered, held.begin = signal, size, close, at, held.bars
        held.stop, held.target = close - signal * atr * rules.sl_atr_mult, close + signal * atr * rules.tp_atr_mult
    held.bars, held.last, held.last_close = held.bars + 1, at, close
    return trade


_HELD = "running double, side int, size double, price double, stop double, target double, entered bigint, begin bigint, bars bigint, last bigint, last_close double"
_STATE = _HELD + ", at array<bigint>, high array<double>, low array<double>, close array<double>, atr array<double>, signal array<int>"


def stream_backtest(signals: DataFrame, rules: Execution, keys=KEYS, lateness: str = "10 minutes") -> DataFrame:
    """Trades (keys and the columns of TRADE) of a streaming table with ts, high, low, close, atr and
    signal, in append mode."""
    keys = tuple(keys)
    # wall-clock time counts as it stands, whatever the session's time zone
    clock = (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")) * 60 + F.minute("ts")
    at = clock.cast("bigint") * 60_000_000 + (F.date_part(F.lit("SECOND"), "ts") * 1_000_000).cast("bigint")
    timed = signals.withColumn("at", at).withColumn("_t", F.timestamp_micros("at")).withWatermark("_t", lateness)
    rows = timed.select(*keys, "_t", "at", *[F.col(c).cast("double").alias(c) for c in _NUMBERS], F.coalesce(F.col("signal"), F.lit(0)).cast("int").alias("signal"))
    start, end = rules.session_start, rules.session_end
    names = [f.name for f in TRADE]
    schema = T.StructType([*[signals.schema[c] for c in keys], *TRADE.fields])

    def inside(at: int) -> bool:
        return start is not None and end is not None and start <= at // 3_600_000_000 % 24 < end

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        held = Held(*known[:11]) if known else Held()
        waiting = {at: bar for at, *bar in zip(*known[11:], strict=True)} if known else {}
        over = False
        for frame in frames:
            for at, high, low, close, atr, signal in zip(frame["at"], *(frame[c] for c in _NUMBERS), frame["signal"], strict=True):
                if math.isnan(close):
                    over = True
                elif at > held.last:
                    waiting.setdefault(int(at), [high, low, close, atr, int(signal)])
        passed = math.inf if over else state.getCurrentWatermarkMs() * 1000
        order = sorted(waiting)
        done = [at for at in order if at <= passed]
        trades = []
        for i, at in enumerate(done):
            following = order[i + 1] if i + 1 < len(order) else None
            if not over and (following is None or following > passed):
                break
            ends = inside(at) and not (following is not None and inside(following))
            trade = judge(held, at, *waiting.pop(at), ends, rules)
            if trade:
                trades.append(trade)
        if over:
            if held.side:
                held.bars -= 1
                trades.append(_close(held, held.last, "EOD", held.last_close, rules))
            if state.exists:
                state.remove()
        else:
            left = sorted(waiting)
            later = [at for at in left if at > passed]
            columns = [list(c) for c in zip(*((at, *waiting[at]) for at in left), strict=True)] or [[]] * 6
            state.update((*astuple(held), *columns))
            if later:
                state.setTimeoutTimestamp(later[0] // 1000 + 1)
        if not trades:
            return
        out = pd.DataFrame(trades, columns=names)
        for c in ("entry_time", "exit_time"):
            out[c] = pd.to_datetime(out[c], unit="us")
        for c, value in zip(keys, key, strict=True):
            out[c] = value
        yield out[[*keys, *names]]

    ship(signals.sparkSession)
    return rows.groupBy(*keys).applyInPandasWithState(advance, schema, _STATE, "append", "EventTimeTimeout")
