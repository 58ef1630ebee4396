"""The classifier overlay: its trees, its features, and the walk-forward against a restatement."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyfold.functions.boosting import BoostedTrees
from tallyfold.operators import backtest as bt
from tallyfold.operators import ml
from tallyfold.operators import strategies as st
from tallyfold.operators.metrics import compute_metrics
from test_kernels import bars, frame

LONG = (100 + np.cumsum(np.random.default_rng(11).normal(size=600))).round(3).tolist()


def test_trees_learn_what_a_table_holds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = BoostedTrees(x[:600], y[:600])
    assert (model.predict(x[:600]) == y[:600]).mean() > 0.98 and (model.predict(x[600:]) == y[600:]).mean() > 0.93
    drawn = rng.integers(0, 2, 900).astype(float)
    noise = BoostedTrees(x[:600], drawn[:600], trees=5)
    assert abs((noise.predict(x[600:]) == drawn[600:]).mean() - 0.5) < 0.12


def test_one_tree_by_hand():
    x, y = np.array([[1.0], [2.0], [3.0], [4.0]]), np.array([0.0, 0.0, 1.0, 1.0])
    # from even odds a leaf's residuals are 1/2 each and its weights 1/4 each
    assert BoostedTrees(x, y, trees=1, depth=1, rate=0.1).score(x).tolist() == [-0.2, -0.2, 0.2, 0.2]
    still = BoostedTrees(np.ones((4, 1)), np.array([0.0, 1.0, 1.0, 1.0]), trees=3)
    np.testing.assert_allclose(still.score(np.ones((1, 1))), np.log(3), atol=1e-12)


def test_the_index_of_the_overlay(spark):
    close = pd.Series(LONG[:60])
    signals = st.SMACrossoverStrategy(st.SMACrossoverParams(fast=3, slow=8)).signals(bars(spark, LONG[:60]))
    gain, loss = (d.clip(lower=0).ewm(alpha=1 / 14, min_periods=14).mean() for d in (close.diff(), -close.diff()))
    got = frame(ml.features(signals).withColumn("asset", F.lit("A")))["rsi"]
    np.testing.assert_allclose(got, 100 - 100 / (1 + gain / loss.replace(0, np.nan)), rtol=1e-9)


def test_overlay_equals_fitting_each_fold(spark):
    params, both = st.SMACrossoverParams(fast=3, slow=8), bars(spark, LONG).unionByName(bars(spark, LONG[::-1], "B")).unionByName(bars(spark, LONG[:150], "short"))
    got = {(r.asset, r.fold, r.variant): r for r in ml.classifier_walk_forward(both, st.SMACrossoverStrategy, params, 3, trees=20).collect()}
    assert {a for a, _, _ in got} == {"A", "B"} and len(got) == 12
    strategy, rows = st.SMACrossoverStrategy(params), both.where("asset = 'A'").orderBy("ts").collect()
    for fold in range(3):
        part = rows[200 * fold : 200 * (fold + 1)]
        first, second = (strategy.signals(spark.createDataFrame(p, both.schema)) for p in (part[:150], part[150:]))
        trades = bt.trades_of(bt.run(first, bt.Execution.of(params)))
        train = ml.labelled(trades, ml.features(first)).toPandas().sort_values(["label", *ml.FEATURES])
        model = BoostedTrees(train[list(ml.FEATURES)].to_numpy(), train["label"].to_numpy(), 20)
        assert got["A", fold, "base"].is_accuracy == (model.predict(train[list(ml.FEATURES)].to_numpy()) == train["label"]).mean()
        asked = ml.features(second).where("signal_dir <> 0").toPandas().fillna(0.0)
        lost = set(asked["ts"][model.predict(asked[list(ml.FEATURES)].to_numpy()) == 0])
        kept = second.withColumn("signal", F.when(F.col("ts").isin(list(lost)), 0).otherwise(F.col("signal")).cast("int")) if lost else second
        for variant, signals in (("base", second), ("filtered", kept)):
            r = bt.run(signals, bt.Execution.of(params))
            want = compute_metrics(bt.trades_of(r), bt.equity_of(r), all_keys=r, p_value=False).first()
            mine = got["A", fold, variant]
            assert (mine.num_trades, round(mine.total_pnl, 9), mine.win_rate) == (want.num_trades, round(want.total_pnl, 9), want.win_rate)
