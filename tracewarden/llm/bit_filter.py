"""A set of 64-bit hashes as a bit field of bounded size: never misses a member, may pass some others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A member sets two bits.  A field has 16 bits a member, but no more than MOST (128 MiB); beyond 64 million members
#: more and more others pass, up to all of them, which costs shuffle but no result.
BITS, LEAST, MOST = 16, 1 << 16, 1 << 30


class BitFilter:
    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the unsigned hashes may be members."""
        return self._bit(keys & self.mask) & self._bit(keys >> np.uint64(32) & self.mask)

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) != 0


def bit_filter(keys: DataFrame, key: str) -> BitFilter:
    """From a column of signed 64-bit hashes.  The driver gets the field, never the members."""
    members = keys.count()
    size = LEAST
    while size < min(MOST, BITS * members):
        size *= 2
    both: list[Column] = [F.col(key).bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(F.col(key), 32).bitwiseAND(F.lit(size - 1))]
    at = keys.select(F.explode(F.array(*both)).alias("at"))
    word = F.shiftright("at", 6).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    table = at.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return BitFilter(words)
