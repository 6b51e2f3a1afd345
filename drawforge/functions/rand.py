"""Portable seeded numbers: the same in numpy and in any SQL with 64-bit integers."""

from __future__ import annotations

import numpy as np

P = 2147483647


def _fifth_power(x: np.ndarray) -> np.ndarray:
    square = x * x % P
    return square * square % P * x % P


def raw(di: np.ndarray, item: np.ndarray, seed: int) -> np.ndarray:
    """Integers in 1..P-1 from (draw, item, seed); every product stays below 2^62."""
    di, item = np.asarray(di, dtype=np.int64), np.asarray(item, dtype=np.int64)
    first = (di * 1000003 + item * 9176 + seed) % (P - 1) + 1
    second = (_fifth_power(first) * 48271 + item * 7919 + 1) % (P - 1) + 1
    return _fifth_power(second)


def uniform(di: np.ndarray, item: np.ndarray, seed: int) -> np.ndarray:
    return raw(di, item, seed) / P
