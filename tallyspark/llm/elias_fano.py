"""A two-level n-gram trie in Elias-Fano form: contexts, pointers to their successors, the successors, and quantised probabilities.

Every level is a monotone sequence, kept as low bits in packed words and high
bits in unary, about 2 + log2(universe / n) bits a number.  Successors are
relative to their context: the sequence of a level is (context's place, word
inside the context), so it rises over the whole level, and a lookup searches
only the stretch that the context's pointers bound.  All levels stand one
behind another in one buffer and are read in place, from bytes or from a
memory-mapped file; a query decodes nothing but what it looks at.
"""

from __future__ import annotations

import struct

import numpy as np

#: Probabilities are kept as -log10(p) in steps of 1 / STEPS; ABSENT is no probability.
STEPS, ABSENT = 4096, 65535
MAGIC = b"EFT1"


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, ABSENT - 1).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 where absent."""
    return np.where(code == ABSENT, 0.0, 10.0 ** (-code.astype(float) / STEPS))


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers of ``width`` bits one behind another in 64-bit words, with a spare word at the end."""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
    room = np.zeros((len(bits) + 63) // 64 * 64 + 64, np.uint8)
    room[: len(bits)] = bits
    return np.packbits(room, bitorder="little").view(np.uint64)


class EliasFano:
    """A monotone sequence of non-negative 63-bit integers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = packed(values & ((1 << width) - 1), width) if width else np.zeros(1, np.uint64)
        buckets = (top - 1 >> width) + 2
        marks = np.zeros((n + buckets + 63) // 64 * 64, np.uint8)
        # bucket h ends with a nought; what follows the last one is ones, so that no further nought is found
        marks[(values >> width) + np.arange(n)] = 1
        marks[n + buckets :] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        noughts = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, width, low, high, (np.cumsum(noughts) - noughts).astype(np.uint32))

    def words(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width, len(self.low), len(self.high)], np.uint64), self.low, self.high, np.pad(self.before, (0, len(self.before) % 2)).view(np.uint64)]

    @classmethod
    def read(cls, words: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, width, low, high = (int(x) for x in words[at : at + 4])
        a, b = at + 4 + low, at + 4 + low + high
        end = b + (high + 1) // 2
        return cls(n, width, words[at + 4 : a], words[a:b], words[b:end].view(np.uint32)[:high]), end

    def nought(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th nought of the high bits stands."""
        word = np.searchsorted(self.before, k, "right") - 1
        left, rest = ~self.high[word], k - self.before[word]
        place = word.astype(np.int64) * 64
        for half in (32, 16, 8, 4, 2, 1):
            part = left & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            up = rest >= ones
            rest = np.where(up, rest - ones, rest)
            left = np.where(up, left >> np.uint64(half), part)
            place += np.where(up, half, 0)
        return place

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        spill = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - off & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> off | spill) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, there): the first place whose number is at least x, n where none is; whether that number is x."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        h, want = x >> self.width, x & ((1 << self.width) - 1)
        last = int(self.before[-1]) + 64 - int(np.bitwise_count(self.high[-1])) - 1
        over, h = h > last, np.minimum(h, last)
        start = np.where(h > 0, self.nought(np.maximum(h - 1, 0)) + 1 - h, 0)
        end = self.nought(h) - h
        lo, hi = start.copy(), end.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.lows(np.minimum(mid, self.n - 1)) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        there = ~over & (lo < end)
        there[there] = self.lows(lo[there]) == want[there]
        return np.where(over, self.n, lo), there

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i, each within 0 to n - 1: the high part is found by bisection over the noughts."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), max(int(self.before[-1]) + 63 - int(np.bitwise_count(self.high[-1])), 0), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            past = self.nought(mid) - mid > i
            lo, hi = np.where(past, lo, np.minimum(mid + 1, hi)), np.where(past, mid, hi)
        return lo << self.width | self.lows(i)


class Trie:
    """Counts of contexts and quantised probabilities of their successors."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, totals: np.ndarray, codes: np.ndarray) -> None:
        self.contexts, self.pointers, self.successors, self.totals, self.codes = contexts, pointers, successors, totals, codes

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> Trie:
        """From n-grams sorted by (context, word), each once; words are 32-bit."""
        first = np.r_[True, context[1:] != context[:-1]] if len(context) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        totals = np.add.reduceat(count, starts) if len(starts) else np.zeros(0, np.int64)
        rank = np.cumsum(first) - 1
        p = (count - discount) / totals[rank] if len(rank) else np.zeros(0)
        return cls(EliasFano.of(context[starts]), EliasFano.of(np.r_[starts, len(context)]), EliasFano.of(rank << 32 | word), totals.astype(np.int64), quantised(p))

    def bytes(self) -> bytes:
        codes = np.pad(self.codes, (0, -len(self.codes) % 4)).view(np.uint64)
        words = [*self.contexts.words(), *self.pointers.words(), *self.successors.words(), self.totals.view(np.uint64), codes]
        return MAGIC + struct.pack("<I", 0) + b"".join(w.tobytes() for w in words)

    @classmethod
    def read(cls, buffer) -> Trie:
        """A trie in a buffer, which may be a memory-mapped file; nothing is copied."""
        view = memoryview(buffer)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a trie")
        words = np.frombuffer(view[8:], np.uint64)
        contexts, at = EliasFano.read(words, 0)
        pointers, at = EliasFano.read(words, at)
        successors, at = EliasFano.read(words, at)
        totals = words[at : at + contexts.n].view(np.int64)
        return cls(contexts, pointers, successors, totals, words[at + contexts.n :].view(np.uint16)[: successors.n])

    def context(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, count, successors) of contexts; place -1 and noughts where there is none."""
        if not self.contexts.n:
            return np.full(len(key), -1), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        i, there = self.contexts.successor(key)
        at = np.where(there, i, 0)
        return np.where(there, i, -1), np.where(there, self.totals[at], 0), np.where(there, self.pointers[at + 1] - self.pointers[at], 0)

    def code(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The quantised probability of a word after the context at a place."""
        out = np.full(len(place), ABSENT, np.uint16)
        known = np.flatnonzero(place >= 0)
        i, there = self.successors.successor(place[known] << 32 | word[known])
        out[known[there]] = self.codes[i[there]]
        return out
