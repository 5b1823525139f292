"""Content-defined cuts of a sequence, alike wherever the same content stands.

Every window of ``width`` consecutive symbols is represented by its anchor: the gram of ``gram`` symbols inside the
window whose hash is smallest (leftmost of equals).  Consecutive windows with one anchor form a *run*.  Two equal
windows have the same anchor at the same offset, so all windows that can be equal meet under one anchor hash,
whatever surrounds them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Odd multipliers of the polynomial and of the bit mixer.
BASE = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

_INVERSE = pow(BASE, -1, 1 << 64)
_TOP = np.uint64(0xFFFFFFFF00000000)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


class Hashes:
    """Hashes of all spans of one sequence of 64-bit values, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers_of(BASE, n), out=self.sums[1:])
        self.back = _powers_of(_INVERSE, n + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, width: int) -> np.ndarray:
        """The hashes of all spans of this width (at least one must fit)."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.back[:n])


class Runs(NamedTuple):
    gram: np.ndarray  # hash of the anchor
    content: np.ndarray  # hash of everything that the run's windows cover
    start: np.ndarray  # first window of the run
    stop: np.ndarray  # after its last window


def runs(values: np.ndarray, width: int, gram: int) -> Runs:
    """The runs of a sequence; none if it is shorter than a window."""
    n = len(values) - width + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return Runs(none, none, np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes = Hashes(values)
    grams = hashes.every(gram)
    low = (grams & _TOP) | np.arange(len(grams), dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.diff(at, prepend=-1))
    stop = np.append(start[1:], n)
    return Runs(grams[at[start]], hashes.span(start, stop + width - 1), start, stop)
