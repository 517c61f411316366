"""Hashes of all windows of an array of numbers, in a few vector passes."""

from __future__ import annotations

import numpy as np

#: An odd factor and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    known = _POWERS.get(kind)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), FACTOR if kind == "up" else INVERSE, "u8")
        steps[0] = 1
        known = _POWERS[kind] = np.multiply.accumulate(steps)
    return known[:n]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of every window of `width` values; none if there are fewer."""
    n = len(values)
    if n < width:
        return np.empty(0, "u8")
    # Values from 1 up, so that leading zeros count.
    terms = (values.astype("u8") + np.uint64(1)) * _powers("down", n)
    sums = np.empty(n + 1, "u8")
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= _powers("up", n)[: len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out
