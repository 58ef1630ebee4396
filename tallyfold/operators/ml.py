"""Classifier overlay: boosted trees that veto signals whose trade they expect to lose.

`fit` trains Spark's own trees on one table of trades of any size; a walk-forward needs many models
of a few hundred trades each, which are fitted side by side in grouped calls (`fold_verdicts`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import kernels as k
from tallyfold.functions.boosting import BoostedTrees
from tallyfold.functions.recursion import Derived, Ewm, with_recursions
from tallyfold.operators.backtest import Execution, equity_of, run, trades_of
from tallyfold.operators.metrics import compute_metrics
from tallyfold.operators.strategies import with_moves
from tallyfold.operators.walkforward import split_folds
from tallyfold.shipping import ship
from tallyfold.staging import staged

FEATURES = ("sma_spread_pct", "atr_pct", "momentum_5", "momentum_20", "rsi", "signal_dir", "hour_sin", "hour_cos")
LEAST_ROWS, LEAST_TRADES, LEAST_OF_CLASS = 100, 10, 3


def features(signals: DataFrame, rsi_period: int = 14, keys=k.KEYS) -> DataFrame:
    """keys, ts and FEATURES for bars with sma_fast, sma_slow, atr and signal. This index uses
    adjusted weights, starts after rsi_period changes and is null without losses."""
    specs = [Ewm("_g", "_gain", 1.0 / rsi_period, rsi_period, True), Ewm("_l", "_loss", 1.0 / rsi_period, rsi_period, True)]
    specs.append(Derived("rsi", lambda f: (100.0 - 100.0 / (1.0 + f["_g"] / f["_l"].where(f["_l"] != 0)))))
    base = signals.drop("rsi").select(*keys, "ts", "close", "sma_fast", "sma_slow", "atr", "signal")
    df = with_recursions(with_moves(base, keys), specs, keys)
    angle = F.hour("ts") * (2.0 * math.pi / 24.0)
    return df.select(
        *keys, "ts", F.try_divide(F.col("sma_fast") - F.col("sma_slow"), F.col("close")).alias("sma_spread_pct"), F.try_divide("atr", "close").alias("atr_pct"),
        k.percent_change("close", 5, keys).alias("momentum_5"), k.percent_change("close", 20, keys).alias("momentum_20"), "rsi",
        F.col("signal").cast("double").alias("signal_dir"), F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"),
    )


def labelled(trades: DataFrame, feats: DataFrame, keys=k.KEYS) -> DataFrame:
    """FEATURES at each trade's entry and label (1 for a gain); missing values are 0."""
    joined = trades.join(feats.withColumnRenamed("ts", "entry_time"), [*keys, "entry_time"], "left")
    return joined.fillna(0.0, list(FEATURES)).withColumn("label", (F.col("pnl_points") > 0).cast("double"))


def fit(train: DataFrame, trees: int = 100) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.1, seed=42),
    ]
    return Pipeline(stages=stages).fit(train)


def verdicts(feats: DataFrame, model: PipelineModel, keys=k.KEYS) -> DataFrame:
    """keys, ts and the model's prediction for rows of features()."""
    return model.transform(feats.fillna(0.0, list(FEATURES))).select(*keys, "ts", "prediction")


def vetoed(signals: DataFrame, verdict: DataFrame, keys=k.KEYS) -> DataFrame:
    """signals with 0 where the verdict is a loss."""
    return signals.join(verdict, [*keys, "ts"], "left").withColumn("signal", F.when(F.col("prediction") == 0.0, 0).otherwise(F.col("signal")).cast("int")).drop("prediction")


def filtered(signals: DataFrame, model: PipelineModel, keys=k.KEYS) -> DataFrame:
    """signals with 0 where the model expects a loss."""
    return vetoed(signals, verdicts(features(signals, keys=keys), model, keys), keys)


def fold_verdicts(train: DataFrame, later: DataFrame, trees: int, by) -> DataFrame:
    """by, ts, prediction and is_accuracy: for each key of train (FEATURES, label) one row without ts
    that has the model's accuracy on its own rows, and a row for each row of later (ts, FEATURES).
    Keys with too few trades or members of a class have no rows. One model is one grouped call."""
    by = tuple(by)
    schema = T.StructType([*[train.schema[c] for c in by], T.StructField("ts", T.TimestampNTZType()), T.StructField("prediction", T.DoubleType()), T.StructField("is_accuracy", T.DoubleType())])
    kinds = [("ts", pa.timestamp("us")), ("prediction", pa.float64()), ("is_accuracy", pa.float64())]

    def judge(known: pa.Table, asked: pa.Table) -> pa.Table:
        # trades in one order, so that a fit does not depend on the exchange
        known = known.sort_by([("label", "ascending"), *[(c, "ascending") for c in FEATURES]])
        x, y = (np.column_stack([t.column(c).to_numpy() for c in FEATURES]) for t in (known, asked)), known.column("label").to_numpy()
        own, new = x
        if len(y) < LEAST_TRADES or min(y.sum(), len(y) - y.sum()) < LEAST_OF_CLASS:
            return pa.Table.from_pylist([], schema=pa.schema([known.schema.field(c) for c in by] + kinds))
        model = BoostedTrees(own, y, trees)
        heads = {c: pa.array([known.column(c)[0].as_py()] * (len(new) + 1), known.schema.field(c).type) for c in by}
        times = pa.concat_arrays([pa.nulls(1, pa.timestamp("us")), asked.column("ts").combine_chunks().cast(pa.timestamp("us"))])
        return pa.table(heads | {"ts": times, "prediction": pa.array([None, *model.predict(new)], pa.float64()), "is_accuracy": pa.array([float((model.predict(own) == y).mean())] + [None] * len(new), pa.float64())})

    ship(train.sparkSession)
    filled = later.select(*by, "ts", *FEATURES).fillna(0.0, list(FEATURES))
    return train.select(*by, *FEATURES, "label").groupBy(*by).cogroup(filled.groupBy(*by)).applyInArrow(judge, schema)


def classifier_walk_forward(bars: DataFrame, strategy_cls, params, n_splits: int = 5, oos_ratio: float = 0.25, trees: int = 100, keys=k.KEYS) -> DataFrame:
    """Metrics of base and filtered signals on each fold's second part. The model of a fold is fitted
    on its first part; folds with too few rows, trades or members of a class are left out. Signals,
    trades, features and models of all folds are one plan."""
    rules, keys = Execution.of(params), tuple(keys)
    by = (*keys, "fold")
    cut = split_folds(bars, n_splits, oos_ratio, keys)
    cut = staged(cut.join(cut.groupBy(*by).count().where(F.col("count") >= LEAST_ROWS).drop("count"), list(by), "left_semi"), "folds")
    strategy = strategy_cls(params, by)
    signals, later = strategy.signals(cut.where("segment = 'is'")), strategy.signals(cut.where("segment = 'oos'"))
    train = labelled(trades_of(run(signals, rules, by), by), features(signals, keys=by), by)
    told = staged(fold_verdicts(train, features(later, keys=by).where("signal_dir <> 0"), trees, by), "verdicts")
    chosen = told.where("ts is null").select(*by, "is_accuracy")
    later = later.join(chosen.select(*by), list(by), "left_semi")
    verdict = told.where("ts is not null").drop("is_accuracy")
    both = later.withColumn("variant", F.lit("base")).unionByName(vetoed(later, verdict, by).withColumn("variant", F.lit("filtered")))
    by = (*by, "variant")
    result = staged(run(both, rules, by), "variants")
    out = compute_metrics(trades_of(result, by), equity_of(result, by), by, all_keys=result, p_value=False).join(chosen, [*keys, "fold"])
    last = ("fold", "variant", "is_accuracy")
    return out.select(*keys, *[c for c in out.columns if c not in (*keys, *last)], *last)
