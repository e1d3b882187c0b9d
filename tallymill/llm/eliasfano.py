"""Elias-Fano sequences on flat arrays, so that they can be mapped from a file.

A non-decreasing sequence of n values below u keeps l = log2(u / n) low bits of each
value packed, and the high parts as a bit vector: one bit a value, one zero a step.
For selection ``zeros`` counts the zeros before each 64-bit word, ``zero_hints`` and
``one_hints`` name the word of every 32nd zero and one. All queries are vectorised
over arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ONE = U(1)
EACH = 5  # a hint for every 2 ** EACH bits of a kind
_BYTES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Place of the k-th set bit of a byte, at 8 * byte + k.
_PLACES = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.int64).ravel()


def _or_into(size: int, words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Words of ``size`` with ``values`` or-ed in at the non-decreasing indices ``words``."""
    out = np.zeros(size, dtype=U)
    if len(words):
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        out[words[starts]] = np.bitwise_or.reduceat(values, starts)
    return out


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of a sequence; ``head`` holds n, universe and l."""
    values = values.astype(U)
    n = len(values)
    bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    at = np.arange(n, dtype=np.int64)
    places = (values >> U(bits)).astype(np.int64) + at
    size = (n + (universe >> bits) + 2) // 64 + 1
    high = _or_into(size, places >> 6, ONE << (places & 63).astype(U))
    zeros = 64 * np.arange(size + 1, dtype=np.int64)
    zeros[1:] -= np.cumsum(np.bitwise_count(high).astype(np.int64))
    low = values & ((ONE << U(bits)) - ONE)
    start = at * bits
    word, shift = start >> 6, (start & 63).astype(U)
    packed = _or_into((n * bits) // 64 + 2, word, low << shift)
    spill = (start & 63) + bits > 64
    packed[word[spill] + 1] |= low[spill] >> ONE >> (U(63) - shift[spill])
    hints = lambda before: (np.searchsorted(before, np.arange(0, before[-1], 1 << EACH), side="right") - 1).astype(np.uint32)
    return {
        "head": np.array([n, universe, bits], dtype=np.int64), "high": high, "zeros": zeros, "low": packed,
        "zero_hints": hints(zeros), "one_hints": hints(64 * np.arange(size + 1, dtype=np.int64) - zeros),
    }


class EliasFano:
    def __init__(self, head: np.ndarray, high: np.ndarray, zeros: np.ndarray, low: np.ndarray, zero_hints: np.ndarray, one_hints: np.ndarray):
        self.n, self.universe, self.bits = (int(x) for x in head)
        self.high, self.zeros, self.low = high, zeros, low
        self.zero_hints, self.one_hints = zero_hints, one_hints
        self.mask = (ONE << U(self.bits)) - ONE

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), dtype=U)
        start = at * self.bits
        word, shift = start >> 6, (start & 63).astype(U)
        return ((self.low[word] >> shift) | (self.low[word + 1] << ONE << (U(63) - shift))) & self.mask

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit (from 0) of each word."""
        sums = word - ((word >> ONE) & U(0x5555555555555555))
        sums = (sums & U(0x3333333333333333)) + ((sums >> U(2)) & U(0x3333333333333333))
        sums = ((sums + (sums >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _BYTES  # byte by byte: set bits up to its end
        k = k.astype(U)
        shift = np.bitwise_count(((k * _BYTES | _TOPS) - sums) & _TOPS).astype(U) << U(3)  # bits in the bytes passed
        k -= (sums << U(8) >> shift) & U(0xFF)
        return shift.astype(np.int64) + _PLACES[(((word >> shift) & U(0xFF)) << U(3) | k).astype(np.int64)]

    def _word(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The word that holds the k-th one or zero (from 0)."""
        before = (lambda w: 64 * w - self.zeros[w]) if ones else self.zeros.__getitem__
        hints = self.one_hints if ones else self.zero_hints
        word = hints[k >> EACH].astype(np.int64)
        open_ = np.flatnonzero(before(word + 1) <= k)
        word[open_] += 1
        open_ = open_[before(word[open_] + 1) <= k[open_]]
        if len(open_):  # the next hint bounds it
            after, low = (k[open_] >> EACH) + 1, word[open_]
            high = np.where(after < len(hints), hints[np.minimum(after, len(hints) - 1)], len(self.high) - 1).astype(np.int64)
            while (low < high).any():
                middle = (low + high + 1) >> 1
                on = before(middle) <= k[open_]
                low, high = np.where(on, middle, low), np.where(on, high, middle - 1)
            word[open_] = low
        return word

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Place in the bit vector of the k-th zero (from 0)."""
        word = self._word(k, False)
        return 64 * word + self._in_word(~self.high[word], k - self.zeros[word])

    def select1(self, k: np.ndarray) -> np.ndarray:
        word = self._word(k, True)
        return 64 * word + self._in_word(self.high[word], k - (64 * word - self.zeros[word]))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        high = (self.select1(at) - at).astype(U)
        return ((high << U(self.bits)) | self._lows(at)).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value at least x, whether that value is x); x below the universe."""
        high = (x >> self.bits).astype(np.int64)
        low = x.astype(U) & self.mask
        before = np.where(high > 0, self.select0(np.maximum(high - 1, 0)), -1)
        at = before + 1 - high
        # The bucket ends at the next zero, mostly in the same word.
        bit = before + 1
        rest = ~(self.high[bit >> 6] >> (bit & 63).astype(U))
        size = np.bitwise_count((rest & (~rest + ONE)) - ONE).astype(np.int64)
        over = size >= 64 - (bit & 63)
        if over.any():
            size[over] = self.select0(high[over]) - bit[over]
        first, end = at.copy(), at + size
        open_ = np.flatnonzero(size > 4)
        last = end[open_]
        while len(open_):  # a bucket of a frequent word's successors can be long: halve it
            middle = (first[open_] + last) >> 1
            less = self._lows(middle) < low[open_]
            first[open_] = np.where(less, middle + 1, first[open_])
            last = np.where(less, last, middle)
            more = first[open_] < last
            open_, last = open_[more], last[more]
        found = np.zeros(len(x), dtype=bool)
        open_ = np.flatnonzero(first < end)
        while len(open_):
            value, sought = self._lows(first[open_]), low[open_]
            found[open_] = value == sought
            open_ = open_[value < sought]
            first[open_] += 1
            open_ = open_[first[open_] < end[open_]]
        return first, found
