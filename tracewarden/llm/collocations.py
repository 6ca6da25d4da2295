"""Phrase collocations by SON partitioning: mine shards completely at lowered support, then count all candidates.

A language's text is dealt to ``SHARDS`` shards by a hash of the text, each worked on by as many tasks as it needs.  A
shard with a share w of the language's bytes mines at local support ceil(support * w): a phrase that stays below it in
every shard stays below the support in all.  Mining goes level by level: words, pairs of locally frequent words,
triples of which both pairs are locally frequent.  What is frequent in some shard is united to the candidates, and one
more pass counts those, as strings, over everything.

Levels pass on a bit field of bounded size (``bit_filter``): it misses no frequent phrase and may let some others
through, which only adds candidates.  Up to levels, phrases are 64-bit hashes that include the language; the counts of
the result are of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.llm.bit_filter import BitFilter, bit_filter
from tracewarden.llm.byte_text import LOWER, Block, blocks, mix
from tracewarden.llm.passing import named
from tracewarden.llm.top_rows import first_rows
from tracewarden.session import cut_lineage

SUPPORT, TOP, SHARDS = 10, 2000, 4
SIZES = (1, 2, 3)
#: Shards of a language whose local support is known to the tasks, largest first; others are mined at support 1.
KNOWN = 1 << 16
#: Bytes of text that a task looks at at a time, and distinct phrases that it combines.
BLOCK, COMBINE = 1 << 18, 1 << 18
_ODD = np.random.default_rng(20_261_202).integers(1 << 62, 1 << 63, (4, 4), dtype=np.uint64) | np.uint64(1)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
#: Bytes of words: no break, space or tab.
_WORD = ~_BREAK
_WORD[[9, 32]] = False


class Phrases:
    """All words of a block, and which of them follow another in one piece."""

    def __init__(self, block: Block, languages: np.ndarray):
        self.block = block
        self.data = LOWER[block.data]
        self.words = words = block.runs(_WORD)
        self.language = languages[words.row]
        self.hashes = block.hashes(words.start, words.end, self.data)
        if len(words) > 1:
            passed = np.concatenate([[0], np.cumsum(_BREAK[block.data])])
            goes_on = (words.row[1:] == words.row[:-1]) & (passed[words.end[:-1]] == passed[words.start[1:]])
        else:
            goes_on = np.zeros(0, bool)
        self.goes_on = np.concatenate([goes_on, [False]])[: len(words)]

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of language and ``size`` words from each start."""
        total = self.language[at] * _ODD[size, 3]
        for k in range(size):
            total = total + self.hashes[at + k] * _ODD[size, k]
        return mix(total)

    def level(self, size: int, below: list[BitFilter]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and keys of all phrases of a size whose parts are frequent; ``below`` holds the levels before."""
        at = np.arange(len(self.words))
        keys = self.keys(at, 1)
        for n in range(2, size + 1):
            known = np.zeros(len(self.words) + 1, bool)
            known[at] = below[n - 2].has(keys)
            at = at[known[at] & known[at + 1] & self.goes_on[np.minimum(at + n - 2, max(0, len(self.words) - 1))]]
            keys = self.keys(at, n)
        return at, keys

    def strings(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases from each start on, joined by one space."""
        start, end = self.words.start[at[:, None] + np.arange(size)], self.words.end[at[:, None] + np.arange(size)]
        width = (end - start).ravel()
        room = width + 1
        room[size - 1 :: size] -= 1
        data = np.full(int(room.sum()), 32, np.uint8)
        data[_runs(np.cumsum(room) - room, width)] = self.data[_runs(start.ravel(), width)]
        offsets = np.concatenate([[0], np.cumsum(room.reshape(-1, size).sum(1))])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _runs(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[k] .. starts[k] + widths[k] - 1``."""
    return np.repeat(starts - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))


def _grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key: one place of it, and the sum of ``n``."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    head = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
    return order[head], np.add.reduceat(n[order], head)


def _mine_batches(shared, size: int):
    """``(part, phrase, n)``: local counts; ``part`` is the shard, times 2**32, plus its local support for the language."""
    names = ["part", "phrase", "n"]

    def combined(parts: list[tuple]) -> tuple:
        part, phrase, n = (np.concatenate(x) for x in zip(*parts))
        one, n = _grouped(phrase + part.view(np.uint64) * _ODD[0, 0], n)
        return part[one], phrase[one], n

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        part, phrase, n = combined(parts)
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(phrase.view(np.int64)), pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needs, below = shared.value
        parts, held = [], 0
        for batch in batches:
            hashes, supports = _of_languages(batch, needs)
            part = (batch.column("shard").to_numpy().astype(np.int64) << 32) + supports
            for block in blocks(batch.column("text"), BLOCK):
                phrases = Phrases(block, hashes[block.lo : block.hi])
                at, keys = phrases.level(size, below)
                row = block.lo + phrases.words.row[at]
                parts.append(combined([(part[row], keys, np.ones(len(at), np.int64))]))
                held += len(parts[-1][1])
                if held >= COMBINE:
                    yield rows(parts)
                    parts, held = [], 0
        if held:
            yield rows(parts)

    return run


def _of_languages(batch: pa.RecordBatch, needs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each row's language, and local support of its shard."""
    coded = batch.column("lang").dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    hashes = next((b.hashes(b.offset[:-1], b.offset[1:]) for b in blocks(coded.dictionary, 1 << 62)), np.zeros(0, np.uint64))
    table = np.array([[needs.get((name, s), 1) for s in range(SHARDS)] for name in names], np.int32).reshape(len(names), SHARDS)
    return hashes[code], table[code, batch.column("shard").to_numpy()]


def _count_batches(shared):
    """``(lang, size, phrase, n)``: counts of the candidates; size 0 counts all words of the language."""
    names = ["lang", "size", "phrase", "n"]

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        keys, lang, size, phrase, n = zip(*parts)
        one, n = _grouped(np.concatenate(keys), np.concatenate(n))
        take = pa.array(one)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(lang).take(take), pa.array(np.concatenate(size)[one]), pa.concat_arrays(phrase).take(take), pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = shared.value
        parts, held = [], 0
        for batch in batches:
            hashes, _ = _of_languages(batch, {})
            lang = batch.column("lang")
            for block in blocks(batch.column("text"), BLOCK):
                phrases = Phrases(block, hashes[block.lo : block.hi])
                many = np.diff(phrases.words.first)
                found = [(np.flatnonzero(many), hashes[block.lo : block.hi][many > 0], many[many > 0])]  # row, key, n of size 0
                for size in SIZES:
                    at, keys = phrases.level(size, fields)
                    hit = fields[size - 1].has(keys)
                    found.append((at[hit], keys[hit], np.ones(int(hit.sum()), np.int64)))
                for size, (at, keys, n) in enumerate(found):
                    one, n = _grouped(keys, n)
                    row = phrases.words.row[at[one]] if size else at[one]
                    phrase = phrases.strings(at[one], size) if size else pa.array([""] * len(one), pa.string())
                    parts.append((keys[one], lang.take(pa.array(block.lo + row)), np.full(len(one), size, np.int32), phrase, n))
                    held += len(one)
                if held >= COMBINE:
                    yield rows(parts)
                    parts, held = [], 0
        if held:
            yield rows(parts)

    return run


def _needs(texts: DataFrame, support: int) -> dict:
    """Local support of the shards of the largest languages."""
    share = texts.groupBy("lang", "shard").agg(F.sum(F.octet_length("text")).alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy("lang"))  # a row a shard
    need = F.expr("(support * bytes + whole - 1) div whole")
    lowered = share.withColumn("whole", whole).withColumn("support", F.lit(support).cast("long")).where("bytes > 0")
    top = lowered.withColumn("need", need).orderBy(F.desc("bytes"), "lang", "shard").limit(KNOWN)
    return {(r["lang"], r["shard"]): r["need"] for r in top.collect()}


def phrase_counts(docs: DataFrame, support: int = SUPPORT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, size, phrase, n)``: all words, pairs and triples that occur ``support`` times or more, exactly counted.

    The row of size 0 has the number of words of the language.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(named(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int"))
    needs, fields = _needs(texts, support), []
    for size in SIZES:
        shared = spark.sparkContext.broadcast((needs, list(fields)))
        mined = texts.mapInArrow(_mine_batches(shared, size), "part long, phrase long, n long")
        local = mined.groupBy("part", "phrase").agg(F.sum("n").alias("n")).where("n >= (part & 4294967295)")
        fields.append(bit_filter(cut_lineage(local.select("phrase").distinct()), "phrase"))
    counted = texts.mapInArrow(_count_batches(spark.sparkContext.broadcast(fields)), "lang string, size int, phrase string, n long")
    counts = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return cut_lineage(counts.where((F.col("size") == 0) | (F.col("n") >= support)))


def _exact_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in whole numbers of 38 digits; a is neither above l nor above r."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r)).cast("long")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of two and three words of each language.

    A null language is ``und``, a null text is empty; every row counts, repeated ones as often as they come.  Texts may
    have any length; a language without a frequent phrase has no rows.
    """
    counts = phrase_counts(docs, support, text_col, lang_col)
    frequent = counts.where("size > 0").select("lang", "size", "phrase", "n")
    word = F.split("phrase", " ")
    part = lambda lo, n: F.array_join(F.slice(word, lo, n), " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), part(1, k).alias("first"), F.array_join(F.slice(word, k + 1, 3), " ").alias("rest"))
    cuts = F.when(F.col("size") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))
    phrases = frequent.where("size > 1").withColumnRenamed("n", "a")
    parts = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    for side, name in (("first", "l"), ("rest", "r")):
        parts = parts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    scored = parts.withColumn("score", _exact_score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = phrases.where("size = 3").select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    flat = whole.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    best = first_rows(flat, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, ["phrase"])
    words = counts.where("size = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
