"""Texts of an Arrow batch as bytes in numpy: words, lines and 64-bit hashes without a Python string each.

A batch is walked in blocks of rows of at most ``BLOCK`` bytes (a longer text is a block of its own), so memory
follows the block and the longest text, never the batch.  Null texts are empty texts.

Hashes are polynomial over random byte values, modulo 2**64, then mixed.  Equal strings have equal hashes; two
different strings of one comparison share one with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RANDOM = np.random.default_rng(20_240_917)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased: digits, letters, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing permutation of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK + 1), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= BLOCK + 1:
            _powers[name] = have
    return have[:n]


@dataclass
class Words:
    """Words in text order: byte ranges and the row of each; ``first[r]:first[r + 1]`` are the words of row r."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


@dataclass
class Block:
    """``data`` holds the bytes of rows ``lo`` to ``hi`` of the batch; row r is ``data[offset[r]:offset[r + 1]]``."""

    lo: int
    hi: int
    data: np.ndarray
    offset: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    @cached_property
    def row_starts(self) -> np.ndarray:
        at = self.offset[:-1]
        return at[at < len(self.data)]

    def runs(self, member: np.ndarray) -> Words:
        """Maximal runs of bytes marked in ``member`` (a table of 256), never across rows."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return Words(none, none, none, np.zeros(self.rows + 1, np.int64))
        inside = member[self.data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[self.row_starts] = inside[self.row_starts]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = self.offset[1:] - 1
        last = last[last >= 0]
        closes[last] = inside[last]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        first = np.searchsorted(start, self.offset)
        row = np.repeat(np.arange(self.rows), np.diff(first))
        return Words(start, end, row, first)

    def hashes(self, start: np.ndarray, end: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges of ``data`` (the block's bytes, or a case-folded copy)."""
        data = self.data if data is None else data
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("base", _BASE, n), out=sums[1:])
        back = _power("inverse", _BASE_INVERSE, n + 1)
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Blocks of consecutive rows of a string column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, values = texts.buffers()
    offset = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo])
        lo = hi


def sums_between(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[r]:first[r + 1]]`` for each r."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
