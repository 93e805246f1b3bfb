"""Minimizers: the same stretch of symbols chooses the same short key wherever it stands."""

from __future__ import annotations

import numpy as np

SYMBOLS = np.full(256, 4, np.int64)
for _i, _c in enumerate(b"acgt"):
    SYMBOLS[_c] = _i


def rolled(codes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Numbers of all stretches of ``size`` symbols, by doubling the stretch."""
    if len(codes) < size:
        return np.zeros(0, np.int64)
    out, have = np.zeros(len(codes) + 1, np.int64), 0
    power, width, block = codes.astype(np.int64), 1, base
    rest = size
    while True:
        n = len(codes) - have - width + 1
        if rest & 1:
            out = out[: n if have == 0 else n] * block + power[have : have + n] if have else power[:n].copy()
            have += width
        rest >>= 1
        if not rest:
            return out[: len(codes) - size + 1]
        power = power[:-width] * block + power[width:]
        block *= block
        width *= 2


def scrambled(numbers: np.ndarray) -> np.ndarray:
    """A fixed shuffling of numbers, so that common stretches are not preferred."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(2)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``."""
    out, have, power, size = values, 1, values, 1
    while have < width:
        step = min(size, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
        size = have
    return out


def stretches(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last window of every stretch of windows with the same minimum."""
    if not len(minima):
        return np.zeros(0, int), np.zeros(0, int)
    cuts = np.flatnonzero(np.r_[True, minima[1:] != minima[:-1], True])
    return cuts[:-1], cuts[1:]
