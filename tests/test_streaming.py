"""The streamed back-test against the batch form: order, lateness, sessions and restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import backtest as bt
from tallyfold.streaming.backtest import stream_backtest
from test_kernels import START

SCHEMA = "`group` string, asset string, tf string, ts timestamp_ntz, high double, low double, close double, atr double, signal int"
COLUMNS = ["asset", "entry_time", "exit_time", "direction", "entry", "exit", "reason", "pnl_points", "bars_held", "size"]
HOUR = datetime.timedelta(hours=1)


def drawn(asset, n, seed):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price += rng.choice([-1.0, -0.5, 0.5, 1.0])
        rows.append(("g", asset, "1h", START + HOUR * i, price + rng.random(), price - rng.random(), price, rng.choice([None, 0.0, 0.7, 1.5]), rng.choice([-1, 0, 0, 0, 1])))
    return rows


def ended(asset, n):
    return ("g", asset, "1h", START + HOUR * n, None, None, None, None, None)


class Stream:
    """Files that arrive one by one, and a query over them that can be stopped and started again."""

    def __init__(self, spark, folder, rules, lateness="6 hours"):
        self.spark, self.folder, self.rules, self.lateness = spark, str(folder), rules, lateness

    def arrive(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder + "/in")

    def run(self):
        arriving = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.folder + "/in")
        trades = stream_backtest(arriving, self.rules, lateness=self.lateness)
        query = trades.writeStream.format("parquet").option("path", self.folder + "/out").option("checkpointLocation", self.folder + "/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in self.spark.read.schema(trades.schema).parquet(self.folder + "/out").select(*COLUMNS).collect())


def batch(spark, rows, rules):
    trades = bt.trades_of(bt.run(spark.createDataFrame(rows, SCHEMA), rules))
    return sorted(tuple(r) for r in trades.select(*COLUMNS).collect())


@pytest.mark.parametrize("rules", [bt.Execution(1.0, 1.5), bt.Execution(2.0, 3.0, session_start=9, session_end=17, sizing_mode="fixed_frac", slippage_points=0.1)])
def test_streamed_trades_equal_batch_trades(spark, tmp_path, rules):
    one, two = drawn("A", 90, 1), drawn("B", 60, 2)
    stream = Stream(spark, tmp_path, rules)
    # bars change places within the lateness, and some come twice
    early = one[:30] + two[:30]
    late = one[28:60] + two[33:]
    early, moved = [r for r in early if r[3].hour % 7 != 5 or r[3] < START + 26 * HOUR], [r for r in early if r[3].hour % 7 == 5 and r[3] >= START + 26 * HOUR]
    random.Random(3).shuffle(early)
    stream.arrive(early, late + moved + two[30:33])
    before = stream.run()
    # a restart goes on from the checkpoint; ended series give up their state
    stream.arrive(one[60:], [ended("A", 90), ended("B", 60)])
    after = stream.run()
    assert 0 < len(before) < len(after) and set(before) <= set(after)
    assert after == batch(spark, one + two, rules)


def test_bars_after_their_turn_are_left_out(spark, tmp_path):
    rows, rules = drawn("A", 60, 4), bt.Execution(1.0, 1.5)
    stream = Stream(spark, tmp_path, rules, "1 hour")
    stream.arrive([r for i, r in enumerate(rows[:40]) if i != 5])
    stream.run()
    stream.arrive([rows[39]], [rows[5], *rows[40:]], [ended("A", 60)])
    assert stream.run() == batch(spark, [r for i, r in enumerate(rows) if i != 5], rules)


def test_the_time_zone_of_the_session_does_not_matter(spark, tmp_path):
    rows, rules = drawn("A", 50, 5), bt.Execution(1.0, 1.5, session_start=9, session_end=17)
    want = batch(spark, rows, rules)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = Stream(spark, tmp_path, rules)
        stream.arrive(rows[:25], rows[25:], [ended("A", 50)])
        assert stream.run() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.range(1).select(F.current_timezone()).first()[0] == "UTC"
