"""Scans of long ordered groups, spread over blocks of time.

A running value of a group depends on all its earlier rows, so a window over the group is one task.
Where the operation is associative, the group is cut into blocks of some days instead: each block is
scanned on its own, what the blocks before it amount to follows from one row per block, and the
blocks are fixed up with it. Sums, maxima and runs are native; exponential averages are affine in
the value they start from, so a block needs only that one number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.kernels import KEYS
from tallyfold.shipping import ship

#: Days of a block.
DAYS = 30
#: Rows of a key, in order, before the given one.
_BEFORE = (Window.unboundedPreceding, -1)


def block_of(time: Column | str, days: int = DAYS) -> Column:
    return F.floor(F.unix_date(F.to_date(time)) / days).cast("int")


def fresh(stem: str, df: DataFrame) -> str:
    while stem in df.columns:
        stem += "_"
    return stem


def running(df: DataFrame, keys, order, value: str, out: str, days: int = DAYS, peak: str | None = None) -> DataFrame:
    """df with `out`, the running sum of value over each key in the given order (whose first column
    is a time), and with `peak`, the highest running sum so far."""
    b, before, earlier = (fresh(n, df) for n in ("_block", "_before", "_earlier"))
    cut = df.withColumn(b, block_of(order[0], days))
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn(out, F.sum(value).over(inside))
    if peak:
        local = local.withColumn(peak, F.max(out).over(inside))
    blocks = local.groupBy(*keys, b).agg(F.sum(value).alias("_sum"), *([F.max(out).alias("_top")] if peak else []))
    sequence = Window.partitionBy(*keys).orderBy(b).rowsBetween(*_BEFORE)
    blocks = blocks.withColumn(before, F.coalesce(F.sum("_sum").over(sequence), F.lit(0.0)))
    if peak:
        blocks = blocks.withColumn(earlier, F.max(F.col(before) + F.col("_top")).over(sequence))
    joined = local.join(blocks.drop("_sum", "_top"), [*keys, b]).withColumn(out, F.col(out) + F.col(before))
    if peak:
        joined = joined.withColumn(peak, F.greatest(F.col(peak) + F.col(before), F.col(earlier)))
    return joined.select(*df.columns, out, *([peak] if peak else []))


def longest_run(df: DataFrame, keys, order, flag: Column, out: str, days: int = DAYS) -> DataFrame:
    """keys and `out`, the most consecutive rows with flag, in order. A block is told by its length,
    the runs at its two ends and the longest one; these compose from block to block."""
    cut = df.select(*keys, block_of(order[0], days).alias("_block"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(flag, F.lit(False)).alias("_flag"))
    by, place = [*keys, "_block"], [f"_o{i}" for i in range(len(order))]
    ordered = Window.partitionBy(*by).orderBy(*place)
    marked = cut.withColumn("_i", F.row_number().over(ordered)).withColumn("_off", F.max(F.when(~F.col("_flag"), F.col("_i"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.col("_i") - F.coalesce("_off", F.lit(0))
    blocks = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(~F.col("_flag"), F.col("_i"))) - 1, F.count(F.lit(1))).alias("head"),
        (F.max("_i") - F.coalesce(F.max("_off"), F.lit(0))).alias("tail"), F.max(run).alias("best"),
    )
    # one row per block: what has been found, and the run that is open at its end
    listed = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", *[F.col(c).cast("long").alias(c) for c in ("n", "head", "tail", "best")]))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("open"))
    step = lambda s, x: F.struct(F.greatest(s["best"], x["best"], s["open"] + x["head"]).alias("best"), F.when(x["head"] == x["n"], s["open"] + x["n"]).otherwise(x["tail"]).alias("open"))
    return listed.select(*keys, F.aggregate("all", start, step, lambda s: s["best"]).alias(out))


def earliest(df: DataFrame, keys, order, n: int, days: int = 1) -> DataFrame:
    """The first n rows of each key in order. Counts per block tell up to which block rows are
    needed, so only those n and the rest of one block are ever put in order."""
    b = fresh("_block", df)
    cut = df.withColumn(b, block_of(order[0], days))
    counts = cut.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(b).rowsBetween(*_BEFORE)), F.lit(0))
    needed = counts.withColumn("_earlier", earlier).where(F.col("_earlier") < n).select(*keys, b)
    place = fresh("_place", df)
    ranked = cut.join(needed, [*keys, b], "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(place) <= n).select(*df.columns)


@dataclass(frozen=True)
class Local:
    """One average over one block, as if nothing came before: its values, how much of a change of
    the first value is left at each row, and where values are."""

    values: np.ndarray
    left: np.ndarray
    where: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, alpha: float) -> Local:
        where = np.flatnonzero(~np.isnan(x))
        left = np.full(len(x), np.nan)
        if len(where):
            old = (1.0 - alpha) ** np.diff(where)
            left[where] = np.cumprod(np.append(1.0, old / (old + alpha)))
        return cls(pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=0).mean().to_numpy(), pd.Series(left).ffill().to_numpy(), where)


def _struct(kinds: dict[str, pa.DataType]) -> list[T.StructField]:
    spark = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.float64(): T.DoubleType()}
    return [T.StructField(name, spark[kind]) for name, kind in kinds.items()]


#: What a block is told by, and what it gets back, for each average.
_SUMMARY = {"_spec": pa.int32()} | dict.fromkeys(("_rows", "_count", "_first", "_last"), pa.int64()) | dict.fromkeys(("_value", "_end", "_left"), pa.float64())
_CARRY = {"_spec": pa.int32(), "_held": pa.float64(), "_start": pa.float64(), "_before": pa.int64()}


def _levels(specs: list) -> list[list]:
    """Specs in runs: an average whose source is made in a run begins a new one."""
    out, made = [[]], set()
    for spec in specs:
        if getattr(spec, "source", None) in made:
            out, made = [*out, []], set()
        out[-1].append(spec)
        made.add(spec.out)
    return out


def scannable(spec) -> bool:
    """Averages that weigh by age alone, and columns computed row by row."""
    return not spec.adjust if hasattr(spec, "alpha") else spec.rowwise


def with_scanned(df: DataFrame, specs: list, keys=KEYS, days: int = DAYS, time: str = "ts") -> DataFrame:
    """df with one double column for each spec (averages and columns computed row by row), each
    series in blocks of time. Equal to with_recursions but for rounding."""
    keys, block = tuple(keys), fresh("_block", df)
    for level in _levels(specs):
        df = _level(df.withColumn(block, block_of(time, days)), level, (*keys, block), keys, time).drop(block)
    return df


def _level(df: DataFrame, specs: list, by: tuple, keys: tuple, time: str) -> DataFrame:
    averages = [s for s in specs if hasattr(s, "alpha")]
    typed = lambda names: T.StructType([df.schema[c] for c in names])
    wide = T.StructType([*df.schema.fields, *[T.StructField(s.out, T.DoubleType()) for s in specs]])

    def heads(table: pa.Table, names, n: int) -> dict:
        return {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in names}

    def source(table: pa.Table, spec) -> np.ndarray:
        return table.column(spec.source).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def summary(table: pa.Table) -> pa.Table:
        table, rows = table.sort_by(time), []
        for i, spec in enumerate(averages):
            x = source(table, spec)
            local = Local.of(x, spec.alpha)
            some = len(local.where) > 0
            rows.append((i, len(x), len(local.where), local.where[0] if some else None, local.where[-1] if some else None, x[local.where[0]] if some else None, local.values[-1] if some else None, local.left[-1] if some else None))
        return pa.table(heads(table, by, len(rows)) | {n: pa.array(c, k) for (n, k), c in zip(_SUMMARY.items(), zip(*rows, strict=True), strict=True)})

    def carry(table: pa.Table) -> pa.Table:
        rows, state = [], {}
        for r in table.sort_by(by[-1]).to_pylist():
            # held: the average so far; at: its last value's place; seen, done: values and rows so far
            held, at, seen, done = state.get(r["_spec"], (None, 0, 0, 0))
            start = r["_value"]
            if held is not None and start is not None:
                alpha = averages[r["_spec"]].alpha
                old = (1.0 - alpha) ** (done + r["_first"] - at)
                start = (old * held + alpha * start) / (old + alpha)
            rows.append({c: r[c] for c in by} | {"_spec": r["_spec"], "_held": held, "_start": start, "_before": seen})
            if start is not None:
                held, at = r["_end"] + r["_left"] * (start - r["_value"]), done + r["_last"]
            state[r["_spec"]] = (held, at, seen + r["_count"], done + r["_rows"])
        return pa.Table.from_pylist(rows, schema=pa.schema([table.schema.field(c) for c in by] + list(_CARRY.items())))

    def fix(table: pa.Table, carried: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        given = {r["_spec"]: r for r in carried.select(list(_CARRY)).to_pylist()}
        frame = table.select([c for c in table.column_names if pa.types.is_floating(table.schema.field(c).type) or pa.types.is_integer(table.schema.field(c).type)]).to_pandas()
        number = 0
        for spec in specs:
            if not hasattr(spec, "alpha"):
                values = spec.of(frame)
            else:
                x, known = source(table, spec), given[number]
                local = Local.of(x, spec.alpha)
                values = local.values
                if len(local.where):
                    values = values + local.left * (known["_start"] - x[local.where[0]])
                if known["_held"] is not None:
                    values[: local.where[0] if len(local.where) else None] = known["_held"]
                seen = known["_before"] + np.cumsum(~np.isnan(x))
                values, number = np.where(seen >= max(spec.least, 1), values, np.nan), number + 1
            frame[spec.out] = values
            table = table.append_column(spec.out, pa.array(values, pa.float64(), from_pandas=True))
        return table

    if not averages:
        raise ValueError("a scan needs an average")
    ship(df.sparkSession)
    summaries = df.groupBy(*by).applyInArrow(summary, T.StructType([*typed(by).fields, *_struct(_SUMMARY)]))
    carries = summaries.groupBy(*keys).applyInArrow(carry, T.StructType([*typed(by).fields, *_struct(_CARRY)]))
    return df.groupBy(*by).cogroup(carries.groupBy(*by)).applyInArrow(fix, wide)
