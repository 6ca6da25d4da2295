"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` long is counted on training texts and then frozen.  A byte
costs minus log2 of its share in the longest context that has seen it, plus the escapes from the longer ones (method
C: the escape weighs as many as the context has followers), down to one of 256 equal bytes.  The language whose
frozen statistics give the shortest exact code for the whole text is predicted.

The tree is kept as sorted tables of n-grams with the finished cost of each for every language, so a whole block of
texts is scored by a few binary searches in numpy.  About ``SAMPLE`` texts of a language of at most ``SAMPLE_BYTES``
bytes, drawn by hash, train the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.byte_text import LOWER, Block, blocks, sums_between
from tracewarden.llm.passing import attach

ORDER = 3
SAMPLE = 500
SAMPLE_BYTES = 1 << 15
UNKNOWN = "und"
#: Before its first byte a text counts as preceded by line feeds.
_LEAD = 0x0A0A0A0A


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at each byte, packed big-endian, and where each row's begin."""
    size = np.diff(block.offset)
    padded = np.full(len(block.data) + ORDER * block.rows, 10, np.uint8)
    row = np.repeat(np.arange(block.rows), size)
    padded[np.arange(len(block.data)) + ORDER * (row + 1)] = LOWER[block.data]
    code = np.zeros(max(0, len(padded) - ORDER), np.uint32)
    for k in range(ORDER + 1):
        code = code << np.uint32(8) | padded[k : len(padded) - ORDER + k]
    return code[np.arange(len(block.data)) + ORDER * row], block.offset


@dataclass
class Level:
    """n-grams of one length: their costs, and the costs of escaping from them as contexts; a column per language."""

    grams: np.ndarray
    cost: np.ndarray
    escape: np.ndarray

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        return at, self.grams[at] == code


def _last(code: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes."""
    return code & np.uint32((1 << 8 * k) - 1)


@dataclass
class Model:
    """``levels[k]`` has the n-grams of k bytes; level 0 is the empty context."""

    languages: list[str] = field(default_factory=list)
    levels: list[Level] = field(default_factory=list)

    def bits(self, block: Block) -> np.ndarray:
        """Code length of every row under every language."""
        out = np.zeros((block.rows, len(self.languages)))
        code, first = grams(block)
        if not self.languages or not len(code):
            return out
        at, known = self.levels[-1].find(code)
        rest = np.flatnonzero(~known)
        extra = self._below(code[rest])
        for k in range(len(self.languages)):
            cost = self.levels[-1].cost[:, k][at]
            cost[rest] = extra[:, k]
            out[:, k] = sums_between(cost, first)
        return out

    def _below(self, code: np.ndarray) -> np.ndarray:
        """Costs of bytes that no language has seen in the longest context."""
        cost = np.zeros((len(code), len(self.languages)))
        left = np.arange(len(code))
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            at, known = level.find(_last(code[left] >> np.uint32(8), k))
            cost[left[known]] += level.escape[at[known]]
            at, known = level.find(_last(code[left], k))
            cost[left[known]] += level.cost[at[known]]
            left = left[~known]
        return cost


def freeze(languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """Trees from counts of the longest n-grams; those of shorter ones are their sums."""
    n = len(languages)
    if not n:
        return Model()
    # the lead is a context of first bytes though it may never be counted itself
    gram, language, count = np.append(gram, _LEAD).astype(np.uint32), np.append(language, 0), np.append(count, 0)
    levels = [Level(np.zeros(1, np.uint32), np.full((1, n), 8.0), np.zeros((1, n)))]
    for k in range(1, ORDER + 2):
        names, at = np.unique(_last(gram, k), return_inverse=True)
        counts = np.zeros((len(names), n))
        np.add.at(counts, (at, language), count)
        below = levels[-1]
        context, _ = below.find(names >> np.uint32(8))
        total, kinds = np.zeros((len(below.grams), n)), np.zeros((len(below.grams), n))
        np.add.at(total, context, counts)
        np.add.at(kinds, context, counts > 0)
        weight = np.maximum(total + kinds, 1)
        below.escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / weight), 0.0)
        shorter, _ = below.find(_last(names, k - 1))
        cost = np.where(counts > 0, -np.log2(np.maximum(counts, 1) / weight[context]), below.escape[context] + below.cost[shorter])
        levels.append(Level(names, cost, np.zeros((len(names), n))))
    return Model(languages, levels)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest n-grams of each language, summed within a block."""
    for batch in batches:
        names, codes = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True) if batch.num_rows else ([], [])
        for block in blocks(batch.column(1)):
            code, first = grams(block)
            language = np.repeat(codes[block.lo : block.hi], np.diff(first))
            both, count = np.unique(language.astype(np.uint64) << np.uint64(32) | code, return_counts=True)
            lang = pa.array([names[k] for k in both >> np.uint64(32)], pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Frozen trees of every language of ``docs``; rows without text or language teach nothing.

    Texts are drawn by a hash of their id whose share follows from how many texts the language has, so nothing is
    gathered to choose them.  What reaches the driver is bounded by the sample: about ``sample * SAMPLE_BYTES`` counts
    a language.
    """
    ident, text = F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")
    usable = docs.select(ident, F.col(lang_col).cast("string").alias("lang"), text).where(F.col("lang").isNotNull() & (F.octet_length("text").between(1, SAMPLE_BYTES)))
    there = usable.groupBy("lang").count().agg(F.map_from_entries(F.collect_list(F.struct("lang", "count")))).scalar()  # a number a language
    share = F.lit(float(sample)) / F.element_at(there, F.col("lang"))
    rows = usable.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, language = np.unique(np.array(counts["lang"].to_pylist(), object), return_inverse=True) if counts.num_rows else (np.array([]), np.array([], int))
    return freeze([str(x) for x in names], language.ravel(), counts["gram"].to_numpy(), counts["n"].to_numpy())


def predict_texts(texts: pa.Array, model: Model) -> list[pa.Array]:
    """``best`` language and ``score``: its share among all languages if each is as likely beforehand."""
    bits = [model.bits(block) for block in blocks(texts)]
    bits = np.concatenate(bits) if bits else np.zeros((0, len(model.languages)))
    if not model.languages:
        return [pa.array([UNKNOWN] * len(bits), pa.string()), pa.array(np.zeros(len(bits)))]
    best = bits.argmin(1)
    shares = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
    return [pa.array([model.languages[k] for k in best], pa.string()), pa.array(1 / shares.sum(1))]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``(row, lang_pred, score)`` of every row of ``docs``; ``row`` holds its columns.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no language was learned.
    Ties go to the language first in order; repeated rows are judged alike; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = attach(docs, text_col, "best string, bits_share double", lambda texts: predict_texts(texts, shared.value))
    spoken = F.coalesce(found["row"].getField(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    return found.select("row", F.when(spoken, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(spoken, F.col("bits_share")).otherwise(0.0).alias("score"))
