"""FM-index over a sequence of symbols cut into segments: count and locate many phrases at once, in numpy."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order.  Zeros end a segment and rank by position, so all suffixes differ.

    Prefix doubling; each round sorts only the suffixes that still share their rank with another.
    """
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group
    reach = 1
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        who = order[slots]
        key = rank[who] * (n + 1) + rank[np.minimum(who + reach, n - 1)]
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[slots] = who
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, slots, 0))
        reach *= 2


class Wavelet:
    """Wavelet matrix: the rank of a symbol before any position, by one bit vector a level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(symbols)
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros(n // 64 * 8 + 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[: len(some)] = some
            words = packed.view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        #: Where each symbol's block begins after the last level.
        self.origin = self.descend(np.arange(size), np.zeros(size, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, at)
            at = np.where(symbol >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``."""
        return self.descend(symbol, at) - self.origin[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit = self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0
            ones = self._ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at - self.origin[symbol]


class FmIndex:
    """Index of ``symbols``: values 1..size-1, and 0 at the end of every segment, the last included."""

    def __init__(self, symbols: np.ndarray, size: int):
        symbols = np.asarray(symbols, np.int64)
        order = suffix_order(symbols)
        starts = np.concatenate([[True], symbols[:-1] == 0])
        segment = np.maximum.accumulate(np.where(starts, np.arange(len(symbols)), 0))
        self.sampled = ((np.arange(len(symbols)) - segment) % SAMPLE == 0)[order]
        self.positions = order[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.transform = Wavelet(symbols[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])[:size]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each phrase (a row of ``phrases``, right-aligned), by backward search."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, len(self.sampled), np.int64)
        alive = np.arange(n)
        for step in range(width):
            alive = alive[(lengths[alive] > step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, width - 1 - step]
            for bound in (low, high):
                bound[alive] = self.smaller[symbol] + self.transform.rank(symbol, bound[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next sampled one (a segment's start always is)."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol, rank = self.transform.symbol_and_rank(rows[walking])
            rows[walking] = self.smaller[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.positions[self.sample_rank[rows]] + steps
