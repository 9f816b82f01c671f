"""Hashes of all substrings that are asked for at once: polynomial hashes, modulo 2**64, by
differences of running sums."""

from __future__ import annotations

import numpy as np

_LETTER = np.random.default_rng(2026).integers(1, 1 << 63, 256).astype(np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(np.take(_LETTER, x) * up[:-1], out=sums[1:])
    return sums, down


def of_ranges(x: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes."""
    sums, down = _sums(x)
    return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def of_length(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes from each place that has so many."""
    sums, down = _sums(x)
    return mixed((sums[n:] - sums[:-n]) * down[: len(x) - n + 1])
