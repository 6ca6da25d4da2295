"""Quality rules: fixed counts, then a logistic regression over hashed word and character n-grams.

Features of a text are the shares of its hashed words, word pairs and byte 4-grams.  The regression is fitted in
numpy on at most ``SAMPLE`` labelled rows of each class (those with the smallest hash of their id, texts of at most
``SAMPLE_BYTES`` bytes), calibrated by a logistic curve on a fifth of them that the fit does not see, and applied in
Arrow batches.  Both classes weigh the same, so the fixed threshold is a likelihood ratio, not a share of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.byte_text import LOWER, NOT_SPACE, Block, Words, blocks, mix, sums_between
from tracewarden.llm.passing import attach, restored

SAMPLE = 1000
SAMPLE_BYTES = 1 << 16
THRESHOLD = 0.5
BITS = 17
SCALE = 30.0
ROUNDS = 120
MIN_WORDS = 20
REPEAT_WINDOW = 8
_FAMILIES = 3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_VISIBLE = NOT_SPACE.copy()
_VISIBLE[0x80:0xC0] = False  # bytes that go on with a character
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def features(block: Block, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: slots of all n-grams in text order, and where each row's begin."""
    shift = np.uint64(64 - BITS)
    data = LOWER[block.data]
    word = block.hashes(words.start, words.end, data)
    out = [((word >> shift).astype(np.int64), words.first)]
    have = np.diff(words.first)
    many = np.maximum(have - 1, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    if len(words) > 1:
        pair = mix(word[:-1] * np.uint64(3) + word[1:])[words.row[1:] == words.row[:-1]]
    else:
        pair = np.zeros(0, np.uint64)
    out.append(((pair >> shift).astype(np.int64) + (1 << BITS), first))
    size = np.diff(block.offset)
    many = np.maximum(size - 3, 0)
    first = np.concatenate([[0], np.cumsum(many)])
    if len(data) > 3:
        code = data[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            code = code << np.uint32(8) | data[k : len(data) - 3 + k]
        inside = np.ones(len(code), bool)
        for k in range(3):  # the last three bytes of a row open no 4-gram
            edge = block.offset[1:-1] - 1 - k
            inside[edge[(edge >= block.offset[:-2]) & (edge < len(code))]] = False
        code = code[inside]
    else:
        code = np.zeros(0, np.uint32)
    slot = code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    out.append((slot.astype(np.int64) + (2 << BITS), first))
    return out


@dataclass
class Model:
    """Weights of all slots, intercept, and the two numbers of the calibration curve."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(_FAMILIES << BITS, np.float32))
    intercept: float = 0.0
    slope: float = 0.0
    shift: float = 20.0  # without labels of both classes every text is taken for good

    def margins(self, block: Block, words: Words) -> np.ndarray:
        z = np.full(block.rows, self.intercept)
        for slots, first in features(block, words):
            z += SCALE * sums_between(self.weights[slots].astype(np.float64), first) / np.maximum(np.diff(first), 1)
        return z

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse feature rows of the sample."""
    for batch in batches:
        slots, shares = [], []
        for block in blocks(batch.column(2)):
            families = features(block, block.runs(NOT_SPACE))
            for r in range(block.rows):
                some = [np.unique(s[f[r] : f[r + 1]], return_counts=True) for s, f in families]
                slots.append(np.concatenate([s for s, _ in some]).astype(np.int32))
                shares.append(np.concatenate([c / max(1, c.sum()) for _, c in some]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["id", "label", "slots", "shares"])


def fit_numpy(y: np.ndarray, slots: list[np.ndarray], shares: list[np.ndarray]) -> Model:
    """Logistic regression by Adam on all rows at once, calibrated on every fifth row."""
    if len(set(y.tolist())) < 2:
        return Model()
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum()))
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(s) for s in slots])
    first = np.concatenate([[0], np.cumsum([len(s) for s in slots])])
    slot = np.concatenate(slots) if slots else np.zeros(0, np.int32)
    value = np.float32(SCALE) * (np.concatenate(shares) if shares else np.zeros(0, np.float32))
    # slots are few: a table renames them, without sorting all entries
    seen = np.zeros(_FAMILIES << BITS, bool)
    seen[slot] = True
    used = np.flatnonzero(seen)
    slot = (np.cumsum(seen, dtype=np.int32) - 1)[slot]
    w, bias = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    margin = lambda: sums_between(w[slot] * value, first) + bias
    for t in range(1, ROUNDS + 1):
        residual = np.where(held, 0, weight * (1 / (1 + np.exp(-np.clip(margin(), -500, 500))) - y))
        gradient = np.append(np.bincount(slot, value * residual[row], len(used)) + 1e-6 * w, residual.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    # calibration: slope and shift by Newton steps, with smoothed targets
    calm = held if held.any() else np.ones(len(y), bool)
    z, t = margin()[calm], y[calm]
    each = np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum()))
    goal = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((t == 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([(each * (p - goal) * z).sum() + 1e-4 * (a - 1), (each * (p - goal)).sum()])
        h = each * np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -5, 5))
    weights = np.zeros(_FAMILIES << BITS, np.float32)
    weights[used] = w
    return Model(weights, float(bias), float(a), float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of each class; labels other than 0 and 1 and null ids are left out."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null")
    order = F.xxhash64("id"), F.col("id")
    picked = marked.where("label = 0").orderBy(*order).limit(sample).unionByName(marked.where("label = 1").orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    # at most 2 * sample small rows are broadcast
    rows = texts.join(F.broadcast(picked), "id").select("id", "label", "text").mapInArrow(_sample_batches, "id long, label int, slots array<int>, shares array<float>").toArrow()
    rows = rows.take(np.lexsort([rows["label"].to_numpy(), rows["id"].to_numpy()])) if rows.num_rows else rows
    lists = lambda name: [np.asarray(x.values) for x in rows[name]]
    return fit_numpy(rows["label"].to_numpy().astype(np.int64), lists("slots"), lists("shares"))


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _distinct(block: Block, keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct keys in each row."""
    owned = mix(keys ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    _, at = np.unique(owned, return_index=True)
    return np.bincount(row[at], minlength=block.rows)


def base_counts(block: Block, words: Words) -> dict[str, np.ndarray]:
    """The fixed counts of each row."""
    n_words = np.diff(words.first)
    byte_first = block.offset
    lines = block.runs(_NOT_NEWLINE)
    spoken = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    start, end, row = lines.start[spoken], lines.end[spoken], lines.row[spoken]
    n_lines = np.bincount(row, minlength=block.rows)
    distinct = _distinct(block, block.hashes(start, end), row)
    repeated = np.zeros(block.rows, np.int64)
    if len(words) >= REPEAT_WINDOW:
        word = block.hashes(words.start, words.end)
        count = len(words) - REPEAT_WINDOW + 1
        window = np.zeros(count, np.uint64)
        for k in range(REPEAT_WINDOW):
            window = window * np.uint64(0xC2B2AE3D27D4EB4F) + word[k : k + count]
        at = np.flatnonzero(words.row[REPEAT_WINDOW - 1 :] == words.row[:count])
        keys = mix(window[at] ^ (words.row[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + REPEAT_WINDOW, -1)
        repeated = sums_between((np.cumsum(edge[:-1]) > 0).astype(np.int64), words.first)
    return {
        "n_words": n_words,
        "word_chars": sums_between(_VISIBLE[block.data].astype(np.int64), byte_first),
        "n_symbols": sums_between(_SYMBOLS[block.data].astype(np.int64), byte_first),
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeated,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeated > 30 * n_words),
    }


def judge_texts(texts: pa.Array, model: Model, threshold: float) -> list[pa.Array]:
    """The columns of ``RULES`` for each text."""
    parts = []
    for block in blocks(texts):
        words = block.runs(NOT_SPACE)
        counts = base_counts(block, words)
        score = model.probabilities(model.margins(block, words))
        parts.append([*counts.values(), score, ~counts["base_failed"] & (score >= threshold)])
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    return [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind) for k, kind in enumerate(kinds)]


def judge(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(row, ...)`` with the counts, ``base_failed``, ``score`` and ``kept`` of every row; ``row`` holds its columns.

    Null and empty texts have no words and fail; repeated rows are judged alike; the length of a text is not limited.
    ``score`` is the calibrated probability of good quality.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return attach(docs, text_col, RULES, lambda texts: judge_texts(texts, shared.value, threshold))


def keep(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    return restored(judge(docs, fit(docs, labels, **names), names.get("text_col", "text")).where("kept"), docs.columns)
