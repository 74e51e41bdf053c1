"""Vectorised hashes of bytes, words and runs of them (64 bits, the same on every worker).

A run of units is hashed by a polynomial with an odd multiplier modulo 2**64, so that prefix sums give the hash
of any run: ``(prefix[end] - prefix[start]) / multiplier**start``. A finaliser spreads the bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


#: A random 64-bit number per byte, and which bytes part words.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, int(n).bit_length()))
    return up[:n], down[:n]


class Runs:
    """Hashes of runs in a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.prefix = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[:-1], out=self.prefix[1:])

    def all(self, length: int) -> np.ndarray:
        """Hash of the run of ``length`` units from every place."""
        if len(self.prefix) <= length:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[length:] - self.prefix[:-length]) * self.down[: len(self.prefix) - length])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each run from ``start`` to before ``end``."""
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, ends: np.ndarray, slice_bytes: int = 1 << 18):
    """``(hash, start, end)`` of every word of concatenated texts that end at ``ends``; words end with their text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = ends[(ends > 0) & (ends < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # whole words, about slice_bytes at a time
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + slice_bytes, "right")))
        base = starts[at]
        runs = Runs(BYTE[data[base : stops[to - 1]]])
        out[at:to] = runs.at(starts[at:to] - base, stops[at:to] - base)
        at = to
    return out, starts, stops
