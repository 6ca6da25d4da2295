"""Substring dedup: words in windows that have occurred before are removed, found by an FM-index per shard.

A window is ``WINDOW`` consecutive words.  Shards are made so that equal windows meet: each window belongs to the
smallest hash among its ``GRAM``-word sequences, its anchor, and consecutive windows with one anchor are a run.  Three
steps:

1. anchors are counted in place; a window can only occur twice if its anchor does.  The anchors that do become a bit
   field of bounded size (``bit_filter``), which may pass others and misses none;
2. runs with such an anchor go to the shard of their anchor, ordered by document and start.  A shard is worked off in
   chunks of about ``CHUNK`` words: the chunk's distinct runs are indexed, all of them are streamed through the index
   by backward search over its wavelet matrix, and the matching statistics give each window that reaches the
   threshold its interval of suffixes.  All windows of one interval but the first are removed.  An anchor with more
   than ``HOT`` occurrences is dealt to several shards, as one of several chunks is: the windows that come first in
   their chunk then meet, one row a chunk, and all but the first go as well;
3. the removed stretches of a document meet its text again, by id and text hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewarden.llm.bit_filter import bit_filter
from tracewarden.llm.byte_text import NOT_SPACE, Block, Words, blocks, mix
from tracewarden.llm.matching import MatchIndex
from tracewarden.llm.passing import as_row, named
from tracewarden.session import cut_lineage

WINDOW = 20
GRAM = 6
#: Windows of a run, at most; words of a chunk; occurrences of an anchor from which on it is dealt to several shards.
RUN, CHUNK, HOT = 64, 1 << 19, 4096
#: Hot anchors that the driver may hold: HOT rises so that there are no more.
HOT_ANCHORS = 1 << 18
_ODD = np.random.default_rng(20_261_201).integers(1 << 62, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)


def runs_of(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[k] .. starts[k] + widths[k] - 1``."""
    return np.repeat(starts - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


def fingerprints(hashes: np.ndarray, start: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each start on."""
    total = np.zeros(len(start), np.uint64)
    for k in range(width):
        total += hashes[start + k] * _ODD[which, k]
    return mix(total)


def windows(block: Block, words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, their anchors, and the hashes of all ``GRAM``-word sequences by start.

    The sequences are shorter in windows of fewer words than ``GRAM``.
    """
    gram = min(GRAM, window)
    hashes = block.hashes(words.start, words.end)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = fingerprints(hashes, np.arange(len(words) - gram + 1), gram)
    least = _slide(grams, window - gram + 1, np.minimum)
    at = np.arange(len(least))
    inside = words.row[at] == words.row[at + window - 1]
    return at[inside], least[inside], grams


def anchor_counts(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of texts, and at how many places each is the anchor of some window."""
    found = []
    for block in blocks(texts):
        at, anchor, grams = windows(block, block.runs(NOT_SPACE), window)
        if len(at):
            reach = window - min(GRAM, window) + 1
            own = np.zeros(len(grams) + reach - 1, np.uint64)  # a window's anchor stands at its start or up to reach - 1 later
            own[at + reach - 1] = anchor
            found.append(grams[(_slide(own, reach, np.maximum) == grams) & (grams > 0)])
    return np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)


def _count_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, count = anchor_counts(batch.column("text"), window)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(count, pa.int64())], ["anchor", "n"])

    return run


def _cut(block: Block, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of a block as strings."""
    data = block.data[runs_of(start, end - start)]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _run_batches(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot, parts = shared.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = block.runs(NOT_SPACE)
                at, anchor, _ = windows(block, words, window)
                if not len(at):
                    continue
                opens = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (words.row[at[1:]] != words.row[at[:-1]])])
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
                first = np.flatnonzero(since % RUN == 0)
                last = np.append(first[1:], len(at)) - 1
                keep = repeated.has(anchor[first])
                first, last = first[keep], last[keep]
                row, begin = words.row[at[first]], at[first] - words.first[words.row[at[first]]]
                key = anchor[first]
                mark = batch.column("mark").to_numpy()[block.lo + row]
                slot = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
                several = parts[slot] if len(hot) else np.ones(len(key), np.int64)
                several = np.where(hot[slot] == key, several, 1) if len(hot) else several
                salt = (mix(mark.view(np.uint64) + begin.astype(np.uint64) * _ODD[0, 0]) % several.astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(np.where(several > 1, salt, -1)), batch.column("id").take(pa.array(block.lo + row)), pa.array(mark),
                        pa.array(begin), pa.array(at[last] + window - at[first]), _cut(block, words.start[at[first]], words.end[at[last] + window - 1]),
                    ],
                    ["anchor", "salt", "id", "mark", "start", "words", "run"],
                )

    return run


class Chunk:
    """Runs of whole anchors, or of a part of one, ordered by anchor, document and start."""

    def __init__(self, runs: pa.Array, window: int):
        self.window = window
        self.block = next(blocks(runs, 1 << 62))
        self.words = self.block.runs(NOT_SPACE)
        self.hashes = self.block.hashes(self.words.start, self.words.end)
        self.size = np.diff(self.words.first)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One row of each text, and of each row the number of its text."""
        power = np.arange(int(self.size.max()))
        total = np.zeros((len(self.size), 2), np.uint64)
        for k in range(2):
            weight = mix(_ODD[k, 0] * (power + 1).astype(np.uint64))[np.arange(len(self.hashes)) - np.repeat(self.words.first[:-1], self.size)]
            sums = np.concatenate([[0], np.cumsum(self.hashes * weight, dtype=np.uint64)]).astype(np.uint64)
            total[:, k] = sums[self.words.first[1:]] - sums[self.words.first[:-1]]
        _, one, number = np.unique(total.view(np.dtype([("a", np.uint64), ("b", np.uint64)])).ravel(), return_index=True, return_inverse=True)
        return one, number

    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every window of every run, in order: its interval (by the first suffix) and its run."""
        one, number = self.distinct()
        size = self.size[one]
        text = runs_of(self.words.first[:-1][one], size)
        vocabulary, symbol = np.unique(self.hashes[text], return_inverse=True)
        begin = np.cumsum(size + 1) - (size + 1)
        symbols = np.zeros(int((size + 1).sum()), np.int64)
        symbols[runs_of(begin, size)] = symbol + 1
        index = MatchIndex(symbols, len(vocabulary) + 1, self.window)
        length, low, _ = index.statistics(symbols, begin, size)
        many = size - self.window + 1
        place = runs_of(begin, many)
        if (length[place] < self.window).any():
            raise AssertionError("a window is not found in the index of its own chunk")
        first = np.cumsum(many) - many
        widths = many[number]
        return low[place][runs_of(first[number], widths)], np.repeat(np.arange(len(number)), widths)


_RESULT = "mark long, first long, last long, f1 long, f2 long"


def judge(table: pa.Table, split: np.ndarray, window: int) -> pa.RecordBatch:
    """Removed stretches of a chunk; of rows in ``split`` also the windows that stay, with their fingerprints."""
    chunk = Chunk(table["run"].combine_chunks(), window)
    interval, row = chunk.intervals()
    anchor, salt = table["anchor"].to_numpy(), table["salt"].to_numpy()
    part = np.concatenate([[0], np.cumsum((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))])  # rows are ordered inside of a part only
    stays = np.zeros(len(interval), bool)
    stays[np.unique(interval * len(part) + part[row], return_index=True)[1]] = True
    start = table["start"].to_numpy()
    opened = np.concatenate([[True], row[1:] != row[:-1]])
    inside = np.arange(len(row)) - np.maximum.accumulate(np.where(opened, np.arange(len(row)), 0))
    goes = ~stays
    begins, ends = goes.copy(), goes.copy()
    begins[1:] &= ~goes[:-1] | opened[1:]
    ends[:-1] &= ~goes[1:] | opened[1:]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    asked = np.flatnonzero(stays & split[row])
    at = chunk.words.first[row[asked]] + inside[asked]
    of = np.concatenate([row[begin], row[asked]])
    first = start[of] + np.concatenate([inside[begin], inside[asked]])
    last = start[of] + np.concatenate([inside[end], inside[asked]]) + window
    marks = [pa.concat_arrays([pa.nulls(len(begin), pa.int64()), pa.array(fingerprints(chunk.hashes, at, window, k).view(np.int64))]) for k in range(2)]
    return pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(of)), table["mark"].combine_chunks().take(pa.array(of)), pa.array(first), pa.array(last), *marks], ["id", "mark", "first", "last", "f1", "f2"])


def _once(table: pa.Table) -> pa.Table:
    """Without runs that repeat the one before: rows of one id and text are one document."""
    if len(table) < 2:
        return table
    same = np.ones(len(table) - 1, bool)
    for name in ("anchor", "mark", "start"):
        value = table[name].to_numpy()
        same &= value[1:] == value[:-1]
    ids = table["id"].combine_chunks()
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    alike = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
    return table.filter(pa.array(np.concatenate([[True], ~(same & (alike | null[1:] & null[:-1]))])))


def _judge_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words, cut = 0, None  # cut: the anchor and salt of which a chunk has been worked off already

        def work(table: pa.Table, whole: bool) -> pa.RecordBatch:
            nonlocal cut
            anchor, salt = table["anchor"].to_numpy(), table["salt"].to_numpy()
            split = salt >= 0
            if cut is not None:
                split |= (anchor == cut[0]) & (salt == cut[1])
            if not whole:
                cut = anchor[-1], salt[-1]
                split |= (anchor == cut[0]) & (salt == cut[1])
            return judge(table, split, window)

        for batch in batches:
            # a batch may hold many chunks
            for lo in range(0, batch.num_rows, 1 << 12):
                held.append(batch.slice(lo, 1 << 12))
                words += pc.sum(held[-1].column("words")).as_py()
                if words < CHUNK:
                    continue
                table = _once(pa.Table.from_batches(held))
                anchor, salt = table["anchor"].to_numpy(), table["salt"].to_numpy()
                other = np.flatnonzero((anchor != anchor[-1]) | (salt != salt[-1]))
                border = int(other[-1]) + 1 if len(other) else 0
                if border:
                    yield work(table.slice(0, border), True)
                    table = table.slice(border)
                words = pc.sum(table["words"]).as_py()
                if words >= CHUNK:
                    yield work(table, False)
                    table, words = table.slice(len(table)), 0
                held = table.combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield work(_once(pa.Table.from_batches(held)), True)

    return run


def _kept_batches(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            ends = pc.fill_null(pc.list_value_length(spans), 0).to_numpy().cumsum()
            flat = spans.flatten()
            first, last = (flat.field(c).to_numpy() for c in ("first", "last"))
            owner = np.searchsorted(ends, np.arange(len(first)), "right")
            for block in blocks(batch.column("text")):
                words = block.runs(NOT_SPACE)
                mine = np.flatnonzero((owner >= block.lo) & (owner < block.hi))
                base = words.first[owner[mine] - block.lo]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, base + first[mine], 1)
                np.add.at(edge, base + last[mine], -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                row = words.row[keep]
                final = np.concatenate([row[1:] != row[:-1], [True]])[: len(row)]
                width = words.end[keep] - words.start[keep]
                data = np.full(int(width.sum()) + int((~final).sum()), 32, np.uint8)
                room = width + ~final
                data[runs_of(np.cumsum(room) - room, width)] = block.data[runs_of(words.start[keep], width)]
                size = np.bincount(row, weights=room, minlength=block.rows).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(size)])
                kept = pa.LargeStringArray.from_buffers(block.rows, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
                many = np.diff(words.first)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(block.lo, block.rows), pa.array(many), pa.array(many - np.bincount(row, minlength=block.rows)), kept], names)

    return run


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, n_words, n_removed, kept)`` for every row of ``docs``; ``row`` holds its columns.

    ``kept`` has the words that are in no window which also starts earlier (in a smaller id, or before in the same
    document), joined by one space.  Windows are judged on the input.  A null id is greater than any other; documents
    of one id are ordered by the hash of their texts; rows of one id and one text are one document and fare alike.
    Null and empty texts have no words and stay; texts of fewer words than ``window`` stay as they are.  A text may
    have any length.
    """
    spark = docs.sparkSession
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    keyed = docs.select(as_row(docs), named(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    counts = keyed.select("text").mapInArrow(_count_batches(window), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.where("n > 1"))
    limit = max(HOT, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_ANCHORS)
    hot = counts.where(F.col("n") > limit).select("anchor", F.ceil(F.col("n") / limit).cast("long").alias("parts")).toArrow()
    value = hot["anchor"].to_numpy().view(np.uint64)
    by = np.argsort(value)
    shared = spark.sparkContext.broadcast((bit_filter(counts, "anchor"), value[by], hot["parts"].to_numpy()[by]))
    id_type = StructField("id", docs.schema[id_col].dataType)
    fields = {f.name: f for f in StructType.fromDDL("anchor long, salt long, mark long, start long, words long, run string").fields}
    schema = StructType([fields["anchor"], fields["salt"], id_type, fields["mark"], fields["start"], fields["words"], fields["run"]])
    runs = keyed.select("id", "mark", "text").mapInArrow(_run_batches(shared, window), schema)
    order = [F.col("id").asc_nulls_last(), "mark", "start"]
    sharded = runs.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", *order)
    found = cut_lineage(sharded.mapInArrow(_judge_batches(window), StructType([id_type, *StructType.fromDDL(_RESULT).fields])))

    again = found.where(F.col("f1").isNotNull())
    place = F.struct(F.col("id").isNull(), "id", "mark", "first")
    earliest = again.groupBy("f1", "f2").agg(F.min(place).alias("earliest"))
    later = again.join(earliest, ["f1", "f2"]).where(~place.eqNullSafe(F.col("earliest")))
    removed = found.where(F.col("f1").isNull()).select("id", "mark", "first", "last").unionByName(later.select("id", "mark", "first", "last"))
    spans = removed.groupBy(F.col("id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    met = keyed.join(spans, (F.col("mark") == F.col("of_mark")) & F.col("id").eqNullSafe(F.col("of")), "left").select("row", "text", "spans")
    result = StructType([StructField("row", keyed.schema["row"].dataType), *StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    return met.mapInArrow(_kept_batches(result.names), result)
