"""Hashes of many byte ranges at once."""

from __future__ import annotations

import numpy as np

#: Fixed values of this library: an odd multiplier, its inverse modulo 2**64, and the
#: multipliers that spread a hash over all its bits.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_SPREAD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_powers: dict[str, np.ndarray] = {}


def _powers_of(base: int, name: str, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.empty(size, np.uint64)
        known[0], done = 1, 1
        while done < size:
            known[done : 2 * done] = known[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[name] = known
    return known[:n]


def spread(values: np.ndarray) -> np.ndarray:
    """Mix the bits of each value; different values stay different."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(_SPREAD[0])
    values ^= values >> np.uint64(27)
    values *= np.uint64(_SPREAD[1])
    values ^= values >> np.uint64(31)
    return values


class Ranges:
    """Polynomial hashes of ranges of an array of bytes, by sums from its start."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self._sums = np.zeros(n + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers_of(_BASE, "up", n)
        np.cumsum(terms, out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each range; equal ranges of bytes have equal hashes wherever they stand."""
        out = self._sums[ends] - self._sums[starts]
        out *= _powers_of(_BACK, "down", len(self._sums))[starts]
        return spread(out)

    def every(self, size: int) -> np.ndarray:
        """Hash of each range of ``size`` bytes, by its start."""
        n = len(self._sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        out = self._sums[size:] - self._sums[:n]
        out *= _powers_of(_BACK, "down", n)
        return spread(out)
