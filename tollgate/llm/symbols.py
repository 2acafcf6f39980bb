"""Texts as arrays of 64-bit symbols - one per byte or one per word - and
fingerprints of their windows, all vectorised."""

from __future__ import annotations

import numpy as np
import xxhash

from tollgate.llm.common import mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_K0, _K1, _32 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: Words longer than this are hashed one by one.
_LONG = 64
#: Odd multipliers of the two window fingerprints.
_BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)
_BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words ``[^\\x20\\x09-\\x0D]+`` (or of
    bytes that are no ``separator``), and the index of each document's first
    word (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word
    first[1:] &= ~word[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    last = last.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal on every machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _K0
    x = eight[starts] & _MASK[np.minimum(size, 8)]
    h ^= x
    h *= _K1
    h ^= h >> _32
    own, at = np.flatnonzero(size > 8), 8
    while len(own) and at < _LONG:
        x = eight[starts[own] + at] & _MASK[np.minimum(size[own] - at, 8)]
        y = (h[own] ^ x) * _K1
        h[own] = y ^ (y >> _32)
        at += 8
        own = own[size[own] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mix(h)


class Bytes:
    """One symbol per UTF-8 byte."""

    bytes_each = 1

    def symbols(self, data: np.ndarray, offsets: np.ndarray):
        return _BYTE_SYMBOLS[data], offsets, None


class Words:
    """One symbol per word ``[^\\x20\\x09-\\x0D]+``."""

    #: About as many bytes as a word takes.
    bytes_each = 6

    def symbols(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(data, offsets)
        return hash_words(data, starts, ends), first, (starts, ends)


_cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse; one table each is kept, as long as the longest so far."""
    if base not in _cached or len(_cached[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 1 << 22:  # for a very long text: not kept
            return out[0], out[1]
        _cached[base] = (out[0], out[1])
    return _cached[base]


class Windows:
    """Fingerprints of windows of a symbol array, from prefix sums modulo 2^64."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        self.power, self.inverse = _powers(_BASES[which], len(symbols) + 1)
        own = symbols if not which else mix(symbols ^ _K0)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(own * self.power[: len(symbols)], out=self.prefix[1:])

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.prefix[at + length] - self.prefix[at]) * self.inverse[at])
