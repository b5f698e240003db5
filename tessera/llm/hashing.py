"""Substring hashes of one text in constant time each, vectorised over positions.

``of`` is a polynomial at a random point modulo the prime 2**61 - 1, so two given different strings of n bytes
get the same value with a chance of n / 2**61 whatever their structure; two of them name what is judged equal.
``grams`` is cheaper, modulo 2**64. It only selects candidates: equal strings have equal values, and a
collision costs a comparison, not a result.
"""

from __future__ import annotations

import numpy as np

from ._common import WORD_SEPARATORS

PRIME = (1 << 61) - 1
_P, _LOW32 = np.uint64(PRIME), np.uint64((1 << 32) - 1)
_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)
_SYMBOLS = np.arange(1, 257, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_POINTS = tuple(int(x) for x in _RNG.integers(1 << 40, PRIME - 1, size=2))
#: Terms summed before a reduction: 2**22 products of a byte and a 32-bit half stay below 2**64.
_STRIDE = 1 << 22
_HALVES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_POWERS: dict[tuple[int | None, bool], np.ndarray] = {}


def folded(x: np.ndarray) -> np.ndarray:
    """The same value modulo the prime, below 2**61 + 8."""
    return (x & _P) + (x >> np.uint64(61))


def reduced(x: np.ndarray) -> np.ndarray:
    """The value below the prime."""
    x = folded(x)
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo the prime, of values below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    top = ((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30))
    return reduced(reduced(top + ((mid & np.uint64((1 << 30) - 1)) << half)) + a0 * b0)


def powers(which: int | None, inverse: bool, n: int) -> np.ndarray:
    """Powers under n of point ``which`` modulo the prime, or (None) of an odd number modulo 2**64; or of the inverse."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        if which is None:
            steps = np.full(size, pow(_ODD, -1, 1 << 64) if inverse else _ODD, dtype=np.uint64)
            steps[0] = 1
            have = np.multiply.accumulate(steps)
        else:
            base = pow(_POINTS[which], -1, PRIME) if inverse else _POINTS[which]
            have = np.ones(1, dtype=np.uint64)
            while len(have) < size:
                have = np.concatenate([have, product(have, np.uint64(pow(base, len(have), PRIME)))])
        _POWERS[which, inverse] = have
    return have[:n]


def halves(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Low 32 and high bits of the powers under n."""
    have = _HALVES.get(which)
    if have is None or len(have[0]) < n:
        steps = powers(which, False, max(n, 1 << 16))
        have = _HALVES[which] = (steps & _LOW32, steps >> np.uint64(32))
    return have[0][:n], have[1][:n]


def prefix_sums(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums modulo the prime, folded only, of the first 0, 1, ... terms ``low + high * 2**32``."""
    out = np.zeros(len(low) + 1, dtype=np.uint64)
    for s in range(0, len(low), _STRIDE):
        a, b = folded(np.cumsum(low[s : s + _STRIDE])), folded(np.cumsum(high[s : s + _STRIDE]))
        # b * 2**32 modulo the prime
        a += b >> np.uint64(29)
        a += (b & np.uint64((1 << 29) - 1)) << np.uint64(32)
        out[s + 1 : s + 1 + len(a)] = folded(a + out[s])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Prefix sums of a text from which any substring's hash follows."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.sums: dict[int, np.ndarray] = {}

    def total(self, which: int) -> np.ndarray:
        if which not in self.sums:
            symbols = _SYMBOLS[self.data]
            low, high = halves(which, len(symbols))
            self.sums[which] = prefix_sums(symbols * low, symbols * high)
        return self.sums[which]

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        total = self.total(which)
        return mixed(product(reduced(total[end] + (_P + _P - total[start])), powers(which, True, len(total))[start]))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.weights() * powers(None, False, n), out=total[1:])
        return mixed((total[size:] - total[:-size]) * powers(None, True, n + 1 - size))

    def weights(self) -> np.ndarray:
        return _TABLE[self.data]

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The bytes that the substring takes."""
        return start, end


_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[list(WORD_SEPARATORS.encode())] = True


class WordHashes(Hashes):
    """The same over runs of words; what separates them doesn't count."""

    def __init__(self, data: bytes) -> None:
        text = Hashes(data)
        turns = np.flatnonzero(np.diff(np.concatenate([[True], _SEPARATES[text.data], [True]])))
        self.first, self.end = turns[::2], turns[1::2]
        self.text, self.data = text, self.first
        self.sums, self.codes = {}, {}

    def code(self, which: int) -> np.ndarray:
        """The words as numbers below the prime."""
        if which not in self.codes:
            self.codes[which] = reduced(self.text.of(self.first, self.end, which))
        return self.codes[which]

    def total(self, which: int) -> np.ndarray:
        if which not in self.sums:
            terms = product(self.code(which), powers(which, False, len(self.data)))
            self.sums[which] = prefix_sums(terms & _LOW32, terms >> np.uint64(32))
        return self.sums[which]

    def weights(self) -> np.ndarray:
        return self.code(0)

    def place(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.end[end - 1])
