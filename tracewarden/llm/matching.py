"""Matching statistics: how far, at most, the text from each position on occurs in an FM-index, and where."""

from __future__ import annotations

import numpy as np

from tracewarden.llm.fm_index import Wavelet, suffix_order


class MatchIndex:
    """FM-index of ``symbols`` (values 1..size-1, 0 ends every segment) with common prefixes known up to ``cap``.

    Kept are the wavelet matrix of the transform, the symbol counts and one byte a suffix for the common prefix with
    the suffix before; the text and the suffix array are not.
    """

    def __init__(self, symbols: np.ndarray, size: int, cap: int):
        symbols = np.asarray(symbols, np.int64)
        order = suffix_order(symbols)
        self.size, self.cap = len(symbols), cap
        self.transform = Wavelet(symbols[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])[:size]
        self.lcp = np.zeros(self.size, np.uint8)
        alike = np.arange(1, self.size)
        for depth in range(cap):
            one, other = symbols[order[alike - 1] + depth], symbols[order[alike] + depth]
            alike = alike[(one == other) & (one > 0)]
            self.lcp[alike] += 1
        self._at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def group(self, depth: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffixes that share their first ``depth`` symbols with that of a row."""
        if depth not in self._at:
            starts = np.flatnonzero(self.lcp < depth)
            number = np.cumsum(self.lcp < depth) - 1
            self._at[depth] = starts[number].astype(np.int32), np.append(starts[1:], self.size)[number].astype(np.int32)
        head, tail = self._at[depth]
        return head[row].astype(np.int64), tail[row].astype(np.int64)

    def _shorter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest wider interval, and how long a match it stands for."""
        below = np.where(high < self.size, self.lcp[np.minimum(high, self.size - 1)], 0)
        depth = np.maximum(self.lcp[low], below).astype(np.int64)
        low, high = np.zeros_like(low), np.full_like(high, self.size)
        return low, high, depth

    def statistics(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each streamed position: length of its longest match (``cap`` at most) and the match's interval of rows.

        Stream k is ``symbols[begin[k]:begin[k] + size[k]]``; symbols below 1 occur nowhere.  All streams are read from
        their ends at once: a step extends each match by the symbol on its left, by backward search; a match that
        cannot be extended, or is as long as ``cap``, first loses symbols on its right.
        """
        length = np.zeros(len(symbols), np.int64)
        low, high = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.size)
        by = np.argsort(-size, kind="stable")
        begin, size = begin[by], size[by]
        n, lo, hi = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64), np.full(len(by), self.size)
        for step in range(int(size[0]) if len(size) else 0):
            lanes = int(np.searchsorted(-size, -step, "left"))
            at = begin[:lanes] + size[:lanes] - 1 - step
            symbol = symbols[at]
            full = np.flatnonzero(n[:lanes] == self.cap)
            if len(full):
                lo[full], hi[full] = self.group(self.cap - 1, lo[full])
                n[full] = self.cap - 1
            lost = np.flatnonzero(symbol < 1)
            n[lost], lo[lost], hi[lost] = 0, 0, self.size
            todo = np.flatnonzero(symbol > 0)
            while len(todo):
                both = np.concatenate([symbol[todo], symbol[todo]])
                bound = self.smaller[both] + self.transform.rank(both, np.concatenate([lo[todo], hi[todo]]))
                left, right = bound[: len(todo)], bound[len(todo) :]
                found = left < right
                good = todo[found]
                lo[good], hi[good], n[good] = left[found], right[found], n[good] + 1
                todo = todo[~found]
                todo = todo[n[todo] > 0]
                if len(todo):
                    row = lo[todo].copy()
                    lo[todo], hi[todo], n[todo] = self._shorter(lo[todo], hi[todo])
                    for depth in np.unique(n[todo][n[todo] > 0]).tolist():
                        these = n[todo] == depth
                        lo[todo[these]], hi[todo[these]] = self.group(depth, row[these])
            length[at], low[at], high[at] = n[:lanes], lo[:lanes], hi[:lanes]
        return length, low, high
