"""Words of UTF-8 texts as numpy arrays: lower-casing, bounds and 64-bit hashes without a Python loop.

A text's words are its longest runs of bytes other than 0x20 and 0x09-0x0D after A-Z are lower-cased.
All of those are ASCII, so working on bytes gives exactly the words of the characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from foliowash.llm.common import WHITE_SPACE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WHITE_SPACE)] = False
_BASE = 0x9E3779B97F4A7C17 | 3
_CHUNK = 1 << 20

with np.errstate(over="ignore"):
    _BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_CHUNK, 1 << int(n - 1).bit_length()) + 1
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            pair = []
            for base in (_BASE % 2**64, pow(_BASE, -1, 2**64)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                pair.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (murmur3's constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """data: the lower-cased bytes; words lie at [start, end); doc: row of each word; first: words before each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        out = np.empty(len(self.start), dtype=np.uint64)
        i, n = 0, len(out)
        while i < n:
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + _CHUNK, "right")))
            s, e = self.start[i:j] - base, self.end[i:j] - base
            power, inverse = _powers(int(e[-1]))
            with np.errstate(over="ignore"):
                part = _BYTE[self.data[base : base + e[-1]]]
                part *= power[: len(part)]
                total = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(part, out=total[1:])
                out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            i = j
        return out


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and n+1 offsets of a string array; nulls count as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    return words_of(*arrow_bytes(texts))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = _LOWER[data]
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def slices(texts: pa.Array, limit: int = 8 << 20):
    """(from, to) row ranges of at most ``limit`` bytes of text each, or one row."""
    n = len(texts)
    if not n:
        return
    _, offsets = arrow_bytes(texts)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spaced(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row joined by single spaces: bytes, and each word's start and end there."""
    keep = _IS_WORD[w.data]
    inner = np.ones(len(w.start), dtype=bool)
    inner[w.first[:-1][w.counts > 0]] = False
    gaps = w.start[inner] - 1
    keep[gaps] = True
    data = w.data.copy()
    data[gaps] = 0x20
    size = w.end - w.start
    start = np.zeros(len(size), dtype=np.int64)
    if len(size):
        np.cumsum(size[:-1] + inner[1:], out=start[1:])
    return data[keep], start, start + size
