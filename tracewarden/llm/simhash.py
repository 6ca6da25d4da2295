"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

Fingerprints are computed where the texts are.  Equal ones collapse to one row before any comparison, so a group of
exact copies costs one fingerprint.  Distinct fingerprints are sorted by the population counts of their four 16-bit
parts and cut into tiles of a fixed size.  Two fingerprints within the radius differ in the population counts of any
parts by at most the radius in sum; tile pairs beyond that are never formed, and inside a pair rows beyond it are
skipped in the same way.  What remains is compared exactly, by exclusive-or and bit count.  A tile pair hands on a
spanning forest of its links, at most one edge a fingerprint, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.byte_text import LOWER, NOT_SPACE, Block, Words, blocks
from tracewarden.llm.components import components
from tracewarden.llm.passing import as_row, named
from tracewarden.session import cut_lineage

SHINGLE = 3
RADIUS = 3
TILE = 2048
SALT = 8
SEED = 42


def shingle_hashes(block: Block, words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each row's shingles in order, and where each row's begin (one more entry than rows)."""
    length = words.end - words.start
    text = np.full(int(length.sum()) + len(words), 32, np.uint8)
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(length + 1, out=begin[1:])
    of_word = np.ones(len(text), bool)
    of_word[begin[1:] - 1] = False
    text[of_word] = LOWER[block.data[NOT_SPACE[block.data]]]
    stop = begin[1:] - 1
    have = np.diff(words.first)
    many = np.where(have >= size, have - size + 1, np.minimum(have, 1))
    first = np.zeros(block.rows + 1, np.int64)
    np.cumsum(many, out=first[1:])
    row = np.repeat(np.arange(block.rows), many)
    opening = np.arange(first[-1]) - first[row] + words.first[row]
    closing = np.minimum(opening + size, words.first[row + 1]) - 1
    raw = text.tobytes()
    cut = map(raw.__getitem__, map(slice, begin[opening].tolist(), stop[closing].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, int(first[-1])), first


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bit is set if it is set in over half of a row's hashes; no hashes: zero.

    Eight bits are counted at once in the byte lanes of a word; runs of at most 255 hashes keep lanes from overflow.
    """
    rows, many = len(first) - 1, np.diff(first)
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(many)
    if not len(full):
        return out
    runs = -(-many[full] // 255)
    run_first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(first[full], runs) + (np.arange(runs.sum()) - np.repeat(run_first, runs)) * 255
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(counts.astype(np.int64), run_first, axis=0)
        for lane in range(8):
            out[full] |= (2 * counts[:, lane] > many[full]).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for block in blocks(batch.column(1)):
            hashes, first = shingle_hashes(block, block.runs(NOT_SPACE))
            parts.append(majority_bits(hashes, first))
        prints = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row, repeated rows and null ids included."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprint_batches, "id long, fp long")


def _part_counts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints to tiles: never more than TILE rows, never across a (hi, lo) class."""
    kind = pa.schema([("hi", pa.int32()), ("lo", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("lead", pa.int64()), ("prints", pa.binary()), ("ids", pa.binary())])

    def tiles(prints, ids, hi, lo):
        cuts = np.flatnonzero((np.diff(hi) != 0) | (np.diff(lo) != 0)) + 1
        spans = [(a, min(a + TILE, z)) for s, z in zip([0, *cuts], [*cuts, len(prints)]) for a in range(s, z, TILE)]
        out = []
        for a, z in spans:
            counts = _part_counts(prints[a:z])
            out.append((int(hi[a]), int(lo[a]), counts.min(0).tolist(), counts.max(0).tolist(), int(prints[a : a + 1].view(np.int64)[0]), prints[a:z].tobytes(), ids[a:z].tobytes()))
        return out

    held: list[np.ndarray] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        prints, ids, hi, lo = cols
        if not len(prints):
            continue
        # the last class may go on in the next batch: keep its unfinished tile
        tail = np.flatnonzero((hi != hi[-1]) | (lo != lo[-1]))
        start = tail[-1] + 1 if len(tail) else 0
        start += (len(prints) - start) // TILE * TILE
        if start:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, t)) for t in tiles(prints[:start].view(np.uint64), ids[:start], hi[:start], lo[:start])], kind)
        held = [c[start:] for c in cols]
    if held and len(held[0]):
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, t)) for t in tiles(held[0].view(np.uint64), *held[1:])], kind)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within the radius."""
    found = [], []
    right_counts = _part_counts(right)
    for a in range(0, len(left), 64):
        rows = left[a : a + 64]
        counts = _part_counts(rows)
        gap = np.maximum(0, np.maximum(counts.min(0) - right_counts, right_counts - counts.max(0))).sum(1)
        near = np.flatnonzero(gap <= radius)
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ right[near][None, :]) <= radius)
        found[0].append(i + a)
        found[1].append(near[j])
    return np.concatenate(found[0]), np.concatenate(found[1])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links between nodes 0..n-1: (node, smallest node of its component)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for fa, ia, fb, ib in zip(*(batch.column(k) for k in range(4))):
                left, right = (np.frombuffer(x.as_py(), np.uint64) for x in (fa, fb))
                ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in (ia, ib)])
                i, j = close_pairs(left, right, radius)
                proper = ids[i] != ids[j + len(left)]
                if proper.any():
                    node, root = forest(i[proper], j[proper] + len(left), len(ids))
                    differ = ids[node] != ids[root]
                    out_a.append(ids[node][differ])
                    out_b.append(ids[root][differ])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` between nodes of ``prints (fp, node)`` that connect all fingerprints within the radius."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    keyed = prints.select("fp", "node", (counts[0] + counts[1]).alias("lo"), (counts[2] + counts[3]).alias("hi"), counts[0].alias("c0"), counts[2].alias("c2"))
    order = ["hi", "lo", "c2", "c0", "fp"]
    tiles = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("fp", "node", "hi", "lo")
    tiles = cut_lineage(tiles.mapInArrow(_tile_batches, "hi int, lo int, low array<int>, high array<int>, lead long, prints binary, ids binary"))
    offsets = [(h, m) for h in range(radius + 1) for m in range(-radius, radius + 1) if h + abs(m) <= radius and (h or m >= 0)]
    steps = F.array(*[F.struct(F.lit(h).alias("dh"), F.lit(m).alias("dl")) for h, m in offsets])
    left = tiles.select("*", F.explode(steps).alias("step")).select(
        (F.col("hi") + F.col("step.dh")).alias("hi"), (F.col("lo") + F.col("step.dl")).alias("lo"),
        F.pmod(F.xxhash64("lead"), F.lit(SALT)).alias("salt"), ((F.col("step.dh") == 0) & (F.col("step.dl") == 0)).alias("same"),
        F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.col("lead").alias("lead_a"), F.col("prints").alias("prints_a"), F.col("ids").alias("ids_a"),
    )
    right = tiles.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALT)])))
    gap = sum(F.greatest(F.lit(0), F.col("low")[k] - F.col("high_a")[k], F.col("low_a")[k] - F.col("high")[k]) for k in range(4))
    pairs = left.join(right, ["hi", "lo", "salt"]).where((~F.col("same") | (F.col("lead_a") <= F.col("lead"))) & (gap <= radius))
    return pairs.select("prints_a", "ids_a", "prints", "ids").mapInArrow(_link_batches(radius), "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` of every fingerprint of ``prints``; root is the smallest fingerprint that links reach.

    Fingerprints are their own nodes, so that those which only rows without an id have link like any other.
    """
    nodes = cut_lineage(prints.groupBy("fp").agg(F.first("fp").alias("node")))
    roots = components(links(nodes, radius))
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id that links of ``radius`` or fewer
    differing bits reach.  Null and empty texts and texts without words have fingerprint zero and link like any
    other.  Repeated rows appear as often as they come.  A null id stays null and names no component: its row links
    like others and gets the component, null if only null ids are in it.  Empty tables give no rows.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    rooted = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("id")).join(groups(prints, radius), "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(found, "fp", "left").select(F.col("id").alias("doc_id"), digits, "component_id")


def _row_hash(docs: DataFrame) -> Column:
    """Of all columns with their names; equal for equal rows only."""
    return F.unhex(F.sha2(F.to_json(as_row(docs)), 256))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id, then of the smallest hash of the whole row.

    Columns are those of ``docs``.  Rows are told apart by their content, not by their id: rows with one id and
    different texts are judged each by its own text.  Of rows without an id, which cannot be ranked by it, one of each
    group stays beside the one with an id.  Texts without words are one group.
    """
    picked = docs.select(F.struct(named(id_col).cast("long").alias("id"), _row_hash(docs).alias("hash")).alias("key"), named(text_col).cast("string").alias("text"))
    rows = cut_lineage(picked.mapInArrow(_fingerprint_batches, "id struct<id:long,hash:binary>, fp long")).select("fp", "id.*")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "hash"))).alias("first")
    bare = F.min(F.when(F.col("id").isNull(), F.col("hash"))).alias("bare")
    per_print = rows.groupBy("fp").agg(first, bare).join(groups(rows, radius), "fp")
    best = per_print.groupBy("root").agg(F.min("first").alias("first"), F.min("bare").alias("bare"))
    chosen = best.select(F.explode(F.array_compact(F.array("first.hash", "bare"))).alias("__hash"))
    copies = rows.groupBy(F.col("hash").alias("__hash")).agg(F.count("*").alias("copies"))
    kept = cut_lineage(chosen.join(copies, "__hash"))
    hashed = _row_hash(docs)
    once = docs.join(kept.where("copies = 1"), hashed == F.col("__hash"), "left_semi")
    again = docs.select(as_row(docs), hashed.alias("__hash")).join(kept.where("copies > 1"), "__hash", "left_semi")
    return once.union(again.dropDuplicates(["__hash"]).select("row.*"))
