"""Elias-Fano coding of increasing sequences in arrays that can be memory-mapped.

Each value is split: its low bits go to a packed array, its high bits, as gaps, to a bit
vector with one set bit per value and one clear bit per step of the high part. A directory
of clear bits per 64-bit word makes both kinds of selection a binary search and a look
into one word. All queries take arrays.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits one after the other in 64-bit words."""
    words = np.zeros(len(values) * bits // 64 + 2, U)
    if bits and len(values):
        at = np.arange(len(values), dtype=U) * U(bits)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(words, word, values << shift)
        over = shift + U(bits) > U(64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return words


def _unpack(words: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), U)
    at = index.astype(U) * U(bits)
    word, shift = (at >> U(6)).astype(np.int64), at & U(63)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return (low | high) & U((1 << bits) - 1)


class EliasFano:
    """An increasing sequence of unsigned integers, equal neighbours allowed."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, clear: np.ndarray):
        self.n, self.bits, self.low, self.high, self.clear = n, bits, low, high, clear

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, U)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        step = (values >> U(bits)).astype(np.int64)
        size = n + (int(step[-1]) if n else 0) + 1
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[step + np.arange(n)] = 1
        marks[size:] = 1      # clear bits end with the last step
        high = np.packbits(marks, bitorder="little").view(U)
        return cls(n, bits, _pack(values & U((1 << bits) - 1), bits), high, cls._directory(high))

    @staticmethod
    def _directory(high: np.ndarray) -> np.ndarray:
        clear = 64 - np.bitwise_count(high).astype(np.int64)
        return np.concatenate([[0], np.cumsum(clear)])

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], U), self.low, self.high, self.clear.astype(U)]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, clear = arrays
        return cls(int(head[0]), int(head[1]), low, high, clear.view(np.int64))

    def _select(self, rank: np.ndarray, of_set: bool) -> np.ndarray:
        """Position of the ``rank``-th set or clear bit."""
        seen = 64 * np.arange(len(self.clear)) - self.clear if of_set else self.clear
        word = np.searchsorted(seen, rank, "right") - 1
        bits = np.unpackbits(self.high[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if not of_set:
            bits = 1 - bits
        inside = rank - seen[word]
        return 64 * word + (np.cumsum(bits, axis=1, dtype=np.uint8) > inside[:, None].astype(np.uint8)).argmax(axis=1)

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at positions."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, U)
        step = self._select(index, True) - index
        return step.astype(U) << U(self.bits) | _unpack(self.low, index, self.bits)

    def find(self, values: np.ndarray) -> np.ndarray:
        """First position of each value, -1 where the sequence lacks it."""
        values = np.asarray(values, U)
        out = np.full(len(values), -1, np.int64)
        last = int(self.clear[-1]) - 1
        step = values >> U(self.bits)
        inside = np.flatnonzero(step <= U(max(0, last))) if self.n else np.zeros(0, np.int64)
        if not len(inside):
            return out
        step, want = step[inside].astype(np.int64), values[inside] & U((1 << self.bits) - 1)
        end = self._select(step, False) - step
        begin = np.zeros(len(step), np.int64)
        some = step > 0
        begin[some] = self._select(step[some] - 1, False) - (step[some] - 1)
        # Low bits rise within a step: a binary search in all of them at once.
        low, high = begin.copy(), end.copy()
        while len(left := np.flatnonzero(low < high)):
            mid = (low[left] + high[left]) // 2
            less = _unpack(self.low, mid, self.bits) < want[left]
            high[left[~less]] = mid[~less]
            low[left[less]] = mid[less] + 1
        hit = low < end
        hit[hit] = _unpack(self.low, low[hit], self.bits) == want[hit]
        out[inside[hit]] = low[hit]
        return out
