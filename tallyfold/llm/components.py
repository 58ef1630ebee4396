"""Connected components by alternating large and small stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common

ROUNDS = 60


def components(links: DataFrame, name: str) -> DataFrame:
    """id and comp (the smallest id that it is connected with) for every end of a link."""
    edges = common.durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    for k in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = common.durable(after, f"{name}-round{k}")
        # stars only: no smaller end is itself the larger end of another link, and each has one
        ends = after.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
        if ends["n"] == ends["u"] and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            edges = after
            break
        edges = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("id"), F.col("u").alias("comp"))
    return common.durable(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots), f"{name}-components")
