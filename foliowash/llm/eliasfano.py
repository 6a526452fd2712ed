"""Elias-Fano coded monotone sequences in numpy, with vectorised successor search."""

from __future__ import annotations

import numpy as np

_SAMPLE = 8  # words of high bits from one count of zeros to the next
_IN_BYTE = np.full((256, 8), 8, dtype=np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _IN_BYTE[_b, _k] = _i


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each 64-bit word."""
    at = np.zeros(len(word), dtype=np.int64)
    for half in (32, 16, 8):
        low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
        right = k >= low
        k = k - np.where(right, low, 0)
        word = np.where(right, word >> np.uint64(half), word)
        at += np.where(right, half, 0)
    return at + _IN_BYTE[(word & np.uint64(255)).astype(np.int64), np.minimum(k, 7)]


class EliasFano:
    """n values below ``universe``: ``width`` low bits each, and the high parts in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        width = max(0, int(universe // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, dtype=np.uint64)
        if width:
            part = values & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift.astype(np.int64) + width > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (values >> np.uint64(width)).astype(np.int64)
        buckets = (universe >> width) + 1
        bits = np.zeros(-(-(n + buckets + 1) // 64) * 64, dtype=np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)
        inside = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, width, low, high, (np.cumsum(inside) - inside)[::_SAMPLE])

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        part = self.low[word] >> shift
        over = shift > 0
        part = np.where(over, part | (self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1)))), part)
        return part & np.uint64((1 << self.width) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        part_of = np.searchsorted(self.zeros, k, "right") - 1
        left, word = k - self.zeros[part_of], part_of * _SAMPLE
        part = ~self.high[word]
        n = np.bitwise_count(part).astype(np.int64)
        todo = np.flatnonzero(n <= left)
        while len(todo):
            left[todo] -= n[todo]
            word[todo] += 1
            part[todo] = ~self.high[word[todo]]
            n[todo] = np.bitwise_count(part[todo])
            todo = todo[n[todo] <= left[todo]]
        return (word << 6) + _select_in_word(part, left)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        ones = np.arange(len(self.zeros)) * (64 * _SAMPLE) - self.zeros  # set bits before each sample
        part_of = np.searchsorted(ones, i, "right") - 1
        left, word = i - ones[part_of], part_of * _SAMPLE
        n = np.bitwise_count(self.high[word]).astype(np.int64)
        todo = np.flatnonzero(n <= left)
        while len(todo):
            left[todo] -= n[todo]
            word[todo] += 1
            n[todo] = np.bitwise_count(self.high[word[todo]])
            todo = todo[n[todo] <= left[todo]]
        top = (word << 6) + _select_in_word(self.high[word], left) - i
        return (top.astype(np.uint64) << np.uint64(self.width)) | self._low_at(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= x or n, whether it equals x); of the values from ``first`` to before
        ``last`` only, if they are given."""
        x = x.astype(np.uint64)
        top = (x >> np.uint64(self.width)).astype(np.int64)
        lo = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) - top + 1, 0)
        hi = self._zero(top) - top
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, last)
        want = x & np.uint64((1 << self.width) - 1)
        end = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # within a bucket of equal high parts, by halving
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low_at(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        equal = lo < end
        equal[equal] = self._low_at(lo[equal]) == want[equal]
        return lo, equal
