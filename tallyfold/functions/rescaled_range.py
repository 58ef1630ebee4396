"""Rescaled-range exponents of many windows at once.

For a chunk length, all chunks of all windows are one array; running sums along it, less the share
of the chunk's total at each place, are the walks, whose ranges over their deviations are averaged
per window. The exponent is the slope of the logarithm of that mean on the logarithm of the length.
"""

from __future__ import annotations

import numpy as np

from tallyfold.functions.spectrum import BATCH, carried

#: Shorter windows have no exponent.
SHORTEST = 16


def chunk_lengths(n: int, least: int) -> list[int]:
    """Doubling from `least` up to half of n."""
    return [least << i for i in range(max(0, (n // 2 // least).bit_length()))] if least > 0 else []


def mean_ratio(windows: np.ndarray, length: int) -> np.ndarray:
    """Mean range over deviation of each window's chunks of a length; chunks without deviation don't
    count, nan if there is no other."""
    chunks = windows[:, : windows.shape[1] // length * length].reshape(len(windows), -1, length)
    sums = np.cumsum(chunks, axis=2)
    walk = sums - sums[:, :, -1:] * (np.arange(1, length + 1) / length)
    deviation = chunks.std(axis=2)
    moved = deviation > 0
    ratio = np.where(moved, np.ptp(walk, axis=2) / np.where(moved, deviation, 1.0), 0.0)
    count = moved.sum(axis=1)
    return np.where(count > 0, ratio.sum(axis=1) / np.maximum(count, 1), np.nan)


def exponents(windows: np.ndarray, least: int = 8) -> np.ndarray:
    """Exponent of each row; nan for rows with a nan, shorter than SHORTEST or twice `least`, or with
    fewer than two chunk lengths that count."""
    lengths = chunk_lengths(windows.shape[1], least)
    if windows.shape[1] < max(SHORTEST, 2 * least) or len(lengths) < 2:
        return np.full(len(windows), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.log(np.column_stack([mean_ratio(windows, length) for length in lengths]))
    known = np.isfinite(y)
    count = np.maximum(known.sum(axis=1, keepdims=True), 1)
    x = np.where(known, np.log(lengths), 0.0)
    x = np.where(known, x - x.sum(axis=1, keepdims=True) / count, 0.0)
    spread = np.square(x).sum(axis=1)
    usable = (known.sum(axis=1) > 1) & ~np.isnan(windows).any(axis=1)
    return np.where(usable, (x * np.where(known, y, 0.0)).sum(axis=1) / np.where(spread > 0, spread, 1.0), np.nan)


def hurst(values: np.ndarray, least: int = 8) -> float:
    return float(exponents(np.asarray(values, float)[None, :], least)[0])


def rolling_hurst(close: np.ndarray, window: int, least: int, step: int) -> np.ndarray:
    """Exponent of the last `window` log returns, every `step` bars, carried forward between."""
    out, bars = np.full(len(close), np.nan), np.arange(window, len(close), step)
    if len(bars):
        spans = np.lib.stride_tricks.sliding_window_view(np.diff(np.log(close)), window)
        for at in range(0, len(bars), BATCH):
            part = bars[at : at + BATCH]
            out[part] = exponents(spans[part - window], least)
    return carried(out)
