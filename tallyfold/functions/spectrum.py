"""Cycle projection as linear maps of whole batches of windows.

Removing a window's line, tapering it and transforming it are linear, and so is the step from the
last bar to the next one of each frequency's wave. So a window length has a fixed matrix, and one
product of windows and matrix gives the coefficients of all frequencies of all windows; limits on
power and on the number of harmonics are masks over that result. Without such limits the whole
projection is one weight per bar.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Windows of one product.
BATCH = 8192


def carried(x: np.ndarray) -> np.ndarray:
    """x with each nan replaced by the last value before it."""
    place = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(place < 0, np.nan, x[place])


class Cycles:
    """The maps for windows of n bars and waves of shortest to longest bars."""

    def __init__(self, n: int, shortest: int, longest: int):
        bar, frequency = np.arange(n), np.arange(1, n // 2 + 1)
        centred = bar - (n - 1) / 2
        #: Weights that give a window's slope.
        self.slope = centred / (centred @ centred)
        wave = np.exp(-2j * np.pi * np.outer(bar, frequency) / n) * np.hanning(n)[:, None]
        #: Coefficients of the window less its line: the line is taken off the waves instead.
        self.transform = wave - wave.mean(axis=0) - np.outer(centred, self.slope @ wave)
        #: What a coefficient adds from the last bar to the next; the highest of an even window counts once.
        turn = (1 - np.exp(-2j * np.pi * frequency / n)) * np.where(2 * frequency == n, 1, 2) / n
        self.turn = turn
        self.band = slice(max(1, n // longest) - 1, -(-n // shortest))
        self.weights = self.slope + (self.transform[:, self.band] * turn[self.band]).real.sum(axis=1)

    def changes(self, windows: np.ndarray, harmonics: int = 0, floor: float = 0.0) -> np.ndarray:
        """Projected change of each window; nan for a flat one and for one whose band holds less
        than the floor's share of power. Of equally strong waves the longer one counts first."""
        still = windows.max(axis=1) == windows.min(axis=1)
        if harmonics <= 0 and floor <= 0:
            return np.where(still, np.nan, windows @ self.weights)
        found = windows @ self.transform
        power = np.square(np.abs(found))
        inside, total = power[:, self.band], power.sum(axis=1)
        steps = (found[:, self.band] * self.turn[self.band]).real
        if 0 < harmonics < inside.shape[1]:
            strongest = np.argsort(-inside, axis=1, kind="stable")[:, :harmonics]
            steps = np.take_along_axis(steps, strongest, axis=1)
        weak = inside.sum(axis=1) < floor * total if floor > 0 else False
        return np.where(still | (total <= 0) | weak, np.nan, steps.sum(axis=1) + windows @ self.slope)


@lru_cache(maxsize=16)
def cycles(n: int, shortest: int, longest: int) -> Cycles:
    return Cycles(n, shortest, longest)


def cycle_weights(n: int, shortest: int, longest: int) -> np.ndarray:
    """The projected change as weights on the last n log closes, without harmonic or power limits."""
    return cycles(n, shortest, longest).weights


def cycle_delta(logs: np.ndarray, shortest: int, longest: int, harmonics: int = 0, floor: float = 0.0) -> float:
    """One-step projection of the band-limited cycle plus trend, minus its value now."""
    return float(cycles(len(logs), shortest, longest).changes(np.asarray(logs, float)[None, :], harmonics, floor)[0])


def rolling_cycle(close: np.ndarray, n: int, shortest: int, longest: int, harmonics: int, floor: float) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if n >= 4 and len(close) >= n:
        windows = np.lib.stride_tricks.sliding_window_view(carried(np.log(close)), n)
        for at in range(0, len(windows), BATCH):
            part = windows[at : at + BATCH]
            out[n - 1 + at : n - 1 + at + len(part)] = cycles(n, shortest, longest).changes(part, harmonics, floor)
    return out
