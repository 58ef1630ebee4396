"""Bars from a stream of ticks: watermarked windows, the streaming form of ticks_to_bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.bars import RULES


def stream_bars(ticks: DataFrame, asset: str, ts: str, price: str, rule: str, lateness: str = "10 minutes", group: str = "ticks", order: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a streaming table, emitted (in append mode) once the watermark has passed them.
    `order` breaks ties of equal times, as in ticks_to_bars."""
    timed = ticks.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", lateness)
    rank = F.struct("_t", *[F.col(c) for c in order])
    out = timed.groupBy(F.col(asset).alias("asset"), F.window("_t", RULES.get(rule, rule)).alias("w")).agg(
        F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, rank).alias("close"), F.count(F.lit(1)).cast("double").alias("tick_vol")
    )
    return out.select(F.lit(group).alias("group"), "asset", F.lit(rule).alias("tf"), F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "tick_vol")
