"""Ordered recursions: exponential averages, and what Hurst exponents and cycle projections need.

They have no window formulation, so each series goes to one Arrow-grouped call in time order; all
recursions of a strategy share that call. Series are independent, and the parallel axis is the
number of series (times parameter combinations and folds). `functions/scan.py` spreads averages of
one long series over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyfold.functions.kernels import KEYS
from tallyfold.functions.rescaled_range import hurst, rolling_hurst
from tallyfold.functions.scan import scannable, with_scanned
from tallyfold.functions.spectrum import cycle_delta, cycle_weights, rolling_cycle
from tallyfold.shipping import ship

__all__ = ["Derived", "Ewm", "cycle_delta", "cycle_weights", "hurst", "rolling_cycle", "rolling_hurst", "span", "with_recursions"]


@dataclass(frozen=True)
class Ewm:
    """Exponential average of source; null before `least` values, weights decay through gaps."""

    out: str
    source: str
    alpha: float
    least: int
    adjust: bool = False

    def of(self, frame: pd.DataFrame) -> np.ndarray:
        return frame[self.source].ewm(alpha=self.alpha, adjust=self.adjust, min_periods=self.least).mean().to_numpy()


@dataclass(frozen=True)
class Derived:
    """A column computed from the frame's columns, between two averages; rowwise if each value
    depends on its own row alone."""

    out: str
    make: Callable[[pd.DataFrame], np.ndarray]
    rowwise: bool = False

    def of(self, frame: pd.DataFrame) -> np.ndarray:
        return np.asarray(self.make(frame), float)


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


#: Session setting: days of a block. Where it is set, averages are scanned block by block.
SCAN_DAYS = "tallyfold.scan.days"


def with_recursions(df: DataFrame, specs: list, keys=KEYS, days: int | None = None) -> DataFrame:
    """df with one double column for each spec, computed in order over each series. With `days` (or
    SCAN_DAYS set in the session) averages and what they need are computed in blocks of so many
    days, so that one long series is many tasks."""
    days = days or int(df.sparkSession.conf.get(SCAN_DAYS, "0"))
    if days and any(isinstance(s, Ewm) and scannable(s) for s in specs):
        # the others look back over rows of the bars themselves, never at an average
        alone, whole = [s for s in specs if scannable(s)], [s for s in specs if not scannable(s)]
        df = with_scanned(df, alone, keys, days)
        return _whole_series(df, whole, keys) if whole else df
    return _whole_series(df, specs, keys)


def _whole_series(df: DataFrame, specs: list, keys) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *[T.StructField(s.out, T.DoubleType()) for s in specs]])
    order = [s.out for s in specs]
    needed = [c for c in df.columns if c not in order]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        frame = table.select([c for c in needed if pa.types.is_floating(table.schema.field(c).type) or pa.types.is_integer(table.schema.field(c).type)]).to_pandas()
        for spec in specs:
            frame[spec.out] = spec.of(frame)
            table = table.append_column(spec.out, pa.array(frame[spec.out], pa.float64(), from_pandas=True))
        return table

    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)
