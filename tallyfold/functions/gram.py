"""Gram matrices of long tables: sums of products of every two names over the days both have.

A self-join by day makes a row per day and pair. Here each block of days is one dense matrix of days
by names in a task, whose products give all pairs at once; blocks are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.shipping import ship

#: Days of a block.
DAYS = 256
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(rows: DataFrame, keys, name: str, value: str, day: str = "day", days: int = DAYS) -> DataFrame:
    """keys, a, b (all ordered pairs of names, equal ones too) and over the days on which both have
    a value: n, sums of either, of either's squares and of products. A name has one value a day."""
    keys = tuple(keys)
    typed = [rows.schema[c] for c in keys]
    schema = T.StructType([*typed, *[T.StructField(c, T.StringType()) for c in "ab"], *[T.StructField(c, T.DoubleType()) for c in _SUMS]])
    block = F.floor(F.unix_date(day) / days).alias("_block")

    def products(table: pa.Table) -> pa.Table:
        names = table.column("_name").combine_chunks().dictionary_encode()
        place, row = names.indices.to_numpy(), np.unique(table.column("_day").to_numpy(), return_inverse=True)[1]
        x, held = np.zeros((2, row.max() + 1, len(names.dictionary)))
        x[row, place], held[row, place] = table.column("_value").to_numpy(), 1.0
        both, sums, squares = held.T @ held, x.T @ held, (x * x).T @ held
        a, b = np.nonzero(both)
        columns = [both[a, b], sums[a, b], sums[b, a], squares[a, b], squares[b, a], (x.T @ x)[a, b]]
        heads = {c: pa.array([table.column(c)[0].as_py()] * len(a), table.schema.field(c).type) for c in keys}
        return pa.table(heads | {"a": names.dictionary.take(pa.array(a)), "b": names.dictionary.take(pa.array(b))} | dict(zip(_SUMS, columns, strict=True)))

    ship(rows.sparkSession)
    wanted = rows.where(F.col(value).isNotNull()).select(*keys, F.col(name).cast("string").alias("_name"), F.unix_date(day).alias("_day"), F.col(value).cast("double").alias("_value"), block)
    return wanted.groupBy(*keys, "_block").applyInArrow(products, schema).groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _moment(n: Column, product: str, left: str, right: str) -> Column:
    return F.col(product) - F.col(left) * F.col(right) / n


def covariance(n: Column | None = None) -> Column:
    """Sample covariance from pair_sums, over n days (those not in the sums count as 0)."""
    n = F.col("n") if n is None else n
    return F.when(n > 1, _moment(n, "sxy", "sx", "sy") / (n - 1))


def correlation(n: Column | None = None) -> Column:
    """Correlation from pair_sums; null without a spread."""
    n = F.col("n") if n is None else n
    spread = _moment(n, "sxx", "sx", "sx") * _moment(n, "syy", "sy", "sy")
    return F.when((n > 1) & (spread > 0), _moment(n, "sxy", "sx", "sy") / F.sqrt(spread))
