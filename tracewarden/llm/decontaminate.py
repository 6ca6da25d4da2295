"""Benchmark decontamination: an FM-index for each shard of training text, searched for all test phrases.

A shard is a block of documents inside a task.  Its words become symbols of the test vocabulary; any other word ends
a segment, since no phrase can run across it, and segments shorter than the shortest phrase are left out.  Test
phrases are searched backwards through wavelet ranks, their occurrences located by sampled suffix positions and
merged into removal spans.  Documents are never shuffled.

The test set is walked in portions of at most ``PORTION`` bytes of text (an item longer than that is a portion of its
own).  Each portion is a broadcast of bounded size, searched by one pass that adds to what the passes before it found;
every ``PASSES`` passes lineage is cut, so a test set of any size needs a bounded number of workers at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewarden.llm.byte_text import ALNUM, LOWER, blocks
from tracewarden.llm.fm_index import FmIndex
from tracewarden.llm.passing import as_row, named
from tracewarden.session import cut_lineage

WINDOW = 13
PORTION = 4 << 20
PASSES = 8


class Phrases:
    """Distinct windows of a portion of the test set, over the vocabulary of their words."""

    def __init__(self, items: list[str], texts: list[str | None]):
        first, last, owner, hashes = [], [], [], []
        total = 0
        for block in blocks(pa.array(texts, pa.large_string())):
            words = block.runs(ALNUM)
            hashes.append(block.hashes(words.start, words.end, LOWER[block.data]))
            have = np.diff(words.first)
            many = np.where(have >= WINDOW, have - WINDOW + 1, np.minimum(have, 1))
            row = np.repeat(np.arange(block.rows), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + words.first[row]
            first.append(at + total)
            last.append(np.minimum(at + WINDOW, words.first[row + 1]) + total)
            owner.append(row + block.lo)
            total += len(words)
        whole = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        first, last, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last, owner))
        self.vocabulary, symbols = np.unique(whole, return_inverse=True)
        lengths = last - first
        at = last[:, None] - np.arange(WINDOW, 0, -1)[None, :]
        inside = at >= first[:, None]
        grid = np.where(inside, symbols[np.where(inside, at, 0)] + 1, 0) if len(first) else np.zeros((0, WINDOW), np.int64)
        self.grid, which = np.unique(grid, axis=0, return_inverse=True)
        self.lengths = (self.grid > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.grid) else 0
        # items of each distinct window, as runs
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
        self.item_first = np.searchsorted(pairs[:, 0], np.arange(len(self.grid) + 1))
        self.item = pairs[:, 1]
        self.names = items


def find(block, words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard: word index, phrase length and phrase number of each."""
    none = np.zeros(0, np.int64)
    if not len(words) or not phrases.shortest:
        return none, none, none
    hashes = block.hashes(words.start, words.end, LOWER[block.data])
    slot = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[slot] == hashes
    opens = known.copy()
    opens[1:] &= ~known[:-1] | (words.row[1:] != words.row[:-1])
    closes = known.copy()
    closes[:-1] &= ~known[1:] | (words.row[1:] != words.row[:-1])
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, none
    size = end - begin + 1  # with the zero that ends a segment
    origin = np.cumsum(size) - size
    place = _runs(begin, size)
    symbols = np.zeros(len(place), np.int64)
    text = np.ones(len(place), bool)
    text[origin + size - 1] = False
    symbols[text] = slot[place[text]] + 1
    index = FmIndex(symbols, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.grid, phrases.lengths)
    many = high - low
    hit = np.flatnonzero(many > 0)
    rows = _runs(low[hit], many[hit])
    number = np.repeat(hit, many[hit])
    return place[index.locate(rows)], phrases.lengths[number], number


FOUND = "n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"
_SPAN = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])
_FOUND = {"n_words": pa.int64(), "spans": pa.list_(_SPAN), "items": pa.list_(pa.string())}


def _runs(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[k] .. starts[k] + widths[k] - 1``."""
    return np.repeat(starts - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())


def search_texts(texts: pa.Array, phrases: Phrases) -> list[pa.Array]:
    """``n_words``, ``spans`` and ``items`` of each text."""
    out: list[list[pa.Array]] = [[pa.array([], kind)] for kind in _FOUND.values()]
    for block in blocks(texts):
        words = block.runs(ALNUM)
        at, length, number = find(block, words, phrases)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        covered = np.cumsum(edge[:-1]) > 0
        opens, closes = covered.copy(), covered.copy()
        if len(words):
            border = words.row[1:] != words.row[:-1]
            opens[1:] &= ~covered[:-1] | border
            closes[:-1] &= ~covered[1:] | border
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = words.row[start]
        first = words.first[row]
        base = block.offset[row]  # spans count from the start of their own text
        span = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - first, end - first, words.start[start] - base, words.end[end - 1] - base)], fields=list(_SPAN))
        width = phrases.item_first[number + 1] - phrases.item_first[number]
        item = phrases.item[_runs(phrases.item_first[number], width)]
        pairs = np.unique(np.repeat(words.row[at], width) * len(phrases.names) + item)
        of_row, item = np.divmod(pairs, max(1, len(phrases.names)))
        cut = lambda owner: pa.array(np.searchsorted(owner, np.arange(block.rows + 1)), pa.int32())  # noqa: E731, B023
        out[0].append(pa.array(np.diff(words.first), pa.int64()))
        out[1].append(pa.ListArray.from_arrays(cut(row), span, type=_FOUND["spans"]))
        out[2].append(pa.ListArray.from_arrays(cut(of_row), pa.array([phrases.names[k] for k in item], pa.string()), type=_FOUND["items"]))
    return [pa.concat_arrays(x) for x in out]


def _search_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in _FOUND]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *search_texts(batch.column("text"), broadcast.value)], [*names, *_FOUND])

    return run


def _portions(tests: DataFrame, id_col: str, text_col: str) -> Iterator[Phrases]:
    """The test set in portions of bounded size; the driver holds one at a time."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    total = tests.agg(F.sum(size)).first()[0] or 0
    item = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    group = F.pmod(F.xxhash64(item, F.col(text_col)), F.lit(total // PORTION + 1))
    keyed = tests.select(item.alias("item"), F.col(text_col).cast("string").alias("body"), group.alias("group"), size.alias("size"))
    so_far = Window.partitionBy("group").orderBy("item", "body").rowsBetween(Window.unboundedPreceding, 0)
    keyed = cut_lineage(keyed.distinct().withColumn("share", F.floor(F.sum("size").over(so_far) / PORTION)))
    for key in keyed.select("group", "share").distinct().orderBy("group", "share").collect():
        rows = keyed.where((F.col("group") == key[0]) & (F.col("share") == key[1])).select("item", "body").collect()
        yield Phrases([r[0] for r in rows], [r[1] for r in rows])


def _merged(spans):
    """Union of spans in word order: overlapping and touching ones become one."""
    start = F.slice(F.array_sort(spans), 1, 1)

    def add(done, x):
        last = F.element_at(done, -1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["first"] <= last["last"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.when(F.size(spans) <= 1, spans).otherwise(F.aggregate(F.array_sort(spans), start, add))


def contamination(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(row, n_words, n_hit, spans, items, contaminated)`` for every row of ``docs``; ``row`` holds its columns.

    ``items`` are the ids of the test items of which a window occurs, sorted as strings; a window is 13 consecutive
    words, or the whole of a shorter item.  ``spans`` are the merged runs of hit words: word indices ``first`` to
    ``last`` (exclusive) and UTF-8 byte offsets ``start`` to ``end``.  Null and empty texts have no words, no hits
    and empty lists; items without words match nothing; a null item id counts as the empty string; repeated rows are
    judged alike, each on its own.  An empty test set finds nothing.
    """
    spark = docs.sparkSession
    base = docs.select(as_row(docs), named(text_col).cast("string").alias("text"))
    found, several = None, False
    for count, phrases in enumerate(_portions(tests, item_col, item_text_col)):
        shared = spark.sparkContext.broadcast(phrases)
        if found is None:
            found = base.mapInArrow(_search_batches(shared), _schema(base))
            continue
        several = True
        kept = found.select("row", "text", F.col("spans").alias("had_spans"), F.col("items").alias("had_items"))
        more = kept.mapInArrow(_search_batches(shared), _schema(kept))
        found = more.select("row", "text", "n_words", F.concat("had_spans", "spans").alias("spans"), F.concat("had_items", "items").alias("items"))
        if count % PASSES == 0:
            found = cut_lineage(found)
    if found is None:
        found = base.mapInArrow(_search_batches(spark.sparkContext.broadcast(Phrases([], []))), _schema(base))
    spans = _merged(F.col("spans")) if several else F.col("spans")
    found = found.select("row", "n_words", spans.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _schema(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(FOUND).fields])


def _without(text, spans):
    """The text without the byte ranges of its spans."""
    raw = F.encode(text, "UTF-8")
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(F.octet_length(text).cast("long")))
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: raw.substr(F.get(bounds, 2 * k).cast("int") + 1, (F.get(bounds, 2 * k + 1) - F.get(bounds, 2 * k)).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(pieces, lambda p: F.decode(p, "UTF-8")), ""))


def clean(docs: DataFrame, tests: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", **names) -> DataFrame:
    """``docs`` without contaminated rows; from the others the removal spans are cut out of the text.

    Columns are those of ``docs``; ``size_col``, if there, is counted anew where a span was cut.
    """
    found = contamination(docs, tests, text_col, **names).where(~F.col("contaminated"))
    row, spans = found["row"], found["spans"]
    text = _without(row.getField(text_col), spans)

    def column(name):
        if name == text_col:
            return text.alias(name)
        if name == size_col:
            return F.when(F.size(spans) > 0, F.char_length(text)).otherwise(row.getField(name)).cast(docs.schema[name].dataType).alias(name)
        return row.getField(name).alias(name)

    return found.select(*[column(c) for c in docs.columns])
