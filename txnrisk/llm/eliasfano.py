"""Monotone sequences in Elias-Fano form, queried for whole arrays at once.

The low bits of each value are packed side by side; the high bits are a unary bit vector in which value i with
high part h sets bit h + i. A directory counts the ones before every 512 bits. Everything lies in flat arrays, so a
sequence can be used straight from a memory-mapped file.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_POP8 = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)
_SELECT8 = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _at = [i for i in range(8) if _byte >> i & 1]
    _SELECT8[_byte, : len(_at)] = _at


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of each value side by side in 64-bit words, one word to spare."""
    words = np.zeros(len(values) * bits // 64 + 2, _U)
    if not bits or not len(values):
        return words
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    values = values.astype(_U)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
    over = np.flatnonzero(shift.astype(np.int64) + bits > 64)  # one value at most reaches into a word
    words[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return words


def unpacked(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), _U)
    at = i.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    return (low | high) & _U((1 << bits) - 1)


def _descend(counts: np.ndarray, rest: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of eight counts in a column, which one holds the ``rest``-th (from 0), and what is left of ``rest`` there."""
    sums = np.cumsum(counts, axis=0, dtype=np.uint16)
    place = np.add.reduce(sums <= rest, axis=0, dtype=np.uint8).astype(np.int64)
    return place, rest - np.where(place > 0, sums[place - 1, each], np.uint16(0))


class EliasFano:
    """``values`` ascending, below ``universe`` (at most 2^64)."""

    FIELDS = ("low", "high", "ones")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 512 - ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(_U)
        high = (values >> _U(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
        length = n + ((universe - 1) >> bits) + 2
        words = np.zeros((length // 512 + 1) * 8, _U)
        at = high + np.arange(n)
        word = at >> 6
        if n:
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[heads]] = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(_U), heads)
        counts = np.bitwise_count(words).astype(np.int64).reshape(-1, 8).sum(axis=1)
        ones = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        return cls(n, bits, packed(values & _U((1 << bits) - 1), bits), words, ones)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        directory = self.ones if ones else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        rest = (k - directory[block]).astype(np.uint16)
        # a row of eight arrays for each step: sums then run along whole arrays, in narrow numbers
        words = self.high[block * 8 + np.arange(8)[:, None]]
        if not ones:
            words = ~words
        each = np.arange(len(k))
        word, rest = _descend(np.bitwise_count(words), rest, each)
        octets = np.ascontiguousarray(words[word, each].view(np.uint8).reshape(-1, 8).T)
        octet, rest = _descend(_POP8[octets], rest, each)
        return block * 512 + word * 64 + octet * 8 + _SELECT8[octets[octet, each], rest]

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, _U)
        high = (self._select(i, True) - i).astype(_U)
        return (high << _U(self.bits)) | unpacked(self.low, self.bits, i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """For each x the place of the first value >= x, within [first, last) where given."""
        x = x.astype(_U)
        if not len(x):
            return np.zeros(0, np.int64)
        high = (x >> _U(self.bits)).astype(np.int64)
        a = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        b = self._select(high, False) - high
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(b, last)
        low = x & _U((1 << self.bits) - 1)
        a, b = a.copy(), np.maximum(a, b)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = unpacked(self.low, self.bits, middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of each x, or -1."""
        at = self.successor(x, first, last)
        end = np.full(len(at), self.n) if last is None else np.minimum(last, self.n)
        out = np.full(len(at), -1, np.int64)
        inside = np.flatnonzero(at < end)
        hit = inside[self.access(at[inside]) == x[inside].astype(_U)]
        out[hit] = at[hit]
        return out
