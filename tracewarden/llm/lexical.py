"""Ranked lexical search: accumulator-limited term-at-a-time scoring over an inverted index in shards of documents.

A shard is a block of documents inside a task.  Its postings (of the words that the queries use) are one row of the
index, a written table that all executors reach; document counts, lengths and document frequencies are sums over it.

A query takes its terms rarest first.  A document gets an accumulator when a term first meets it.  As soon as the
largest gains that the remaining terms can still give add up to less than the k-th best partial score, of this shard
or of what the task has seen before, a new accumulator cannot reach the result: none is made any more, while the
remaining terms still update those that are there, exactly.  A shard gives at most ``k`` documents a query.

The queries are walked in portions of about ``PORTION`` bytes of text, dealt by a hash of their id; each is a
broadcast of bounded size and one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tracewarden.llm.byte_text import ALNUM, LOWER, blocks
from tracewarden.llm.passing import named
from tracewarden.llm.top_rows import first_rows
from tracewarden.session import cut_lineage

K = 50
SHARD = 4 << 20
PORTION = 4 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_POSTINGS = "n array<long>, with_terms long, total long, df array<struct<term:int,count:long>>, doc array<int>, tf array<long>"


def terms_of(text: Column) -> Column:
    """Distinct terms of a text as an array: only A-Z are lower-cased."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"({_TERM})"), F.lit(1)))


@dataclass
class Queries:
    """A portion of the queries: their ids and, as numbers of its vocabulary, their terms."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        """From ``(id, terms)`` rows."""
        block = [(i, _hashes(t)) for i, t in rows]
        vocabulary = np.unique(np.concatenate([h for _, h in block] or [np.zeros(0, np.uint64)]))
        return Queries([i for i, _ in block], vocabulary, [np.searchsorted(vocabulary, h) for _, h in block])


def _hashes(terms: list[str]) -> np.ndarray:
    parts = [b.hashes(b.offset[:-1], b.offset[1:]) for b in blocks(pa.array(terms, pa.string()))]
    return np.concatenate(parts or [np.zeros(0, np.uint64)])


def _lists(kind: pa.DataType, parts: list) -> pa.ListArray:
    """One list for each part."""
    values = [p if isinstance(p, pa.Array) else pa.array(p, kind.value_type) for p in parts]
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], kind.value_type), *values]))


def postings(block, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: terms of each document, then the terms that occur, how many documents hold each, documents, counts."""
    words = block.runs(ALNUM)
    hashes = block.hashes(words.start, words.end, LOWER[block.data])
    slot = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
    known = vocabulary[slot] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    pair, tf = np.unique(slot[known] * block.rows + words.row[known], return_counts=True)
    term, doc = np.divmod(pair, block.rows)
    terms, count = np.unique(term, return_counts=True)
    return np.diff(words.first), terms, count, doc, tf


def _index(shared, id_type: pa.DataType):
    pair = pa.struct([("term", pa.int32()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        for batch in batches:
            for block in blocks(batch.column("text"), SHARD):
                n, terms, count, doc, tf = postings(block, vocabulary)
                df = pa.StructArray.from_arrays([pa.array(terms, pa.int32()), pa.array(count, pa.int64())], fields=list(pair))
                yield pa.RecordBatch.from_arrays(
                    [
                        _lists(pa.list_(id_type), [batch.column("id").slice(block.lo, block.rows).cast(id_type)]),
                        _lists(pa.list_(pa.int64()), [n]),
                        pa.array([int((n > 0).sum())], pa.int64()),
                        pa.array([int(n.sum())], pa.int64()),
                        _lists(pa.list_(pair), [df]),
                        _lists(pa.list_(pa.int32()), [doc]),
                        _lists(pa.list_(pa.int64()), [tf]),
                    ],
                    ["id", "n", "with_terms", "total", "df", "doc", "tf"],
                )

    return run


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Ranker:
    """Scores shards one after another for all queries of a portion; keeps the best scores that it has seen."""

    def __init__(self, queries: Queries, weights: np.ndarray, documents: int, total: int, k: int):
        # rarest first; a term without weight adds nothing
        self.terms = [t[np.argsort(-weights[t], kind="stable")] for t in (t[weights[t] > 0] for t in queries.terms)]
        self.weights, self.documents, self.total, self.k = weights, documents, total, k
        self.seen = np.zeros((len(queries.ids), k), np.int64)

    def shard(self, n: np.ndarray, terms: np.ndarray, count: np.ndarray, doc: np.ndarray, tf: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, document and score of at most ``k`` documents a query; ``order`` ranks documents of equal scores."""
        m = 50 + 50 * n * self.documents // max(1, self.total)
        ends = np.cumsum(count)
        begins = ends - count
        gain = np.repeat(self.weights[terms], count) * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        most = np.maximum.reduceat(gain, begins) if len(gain) else gain
        out = []
        for query, wanted in enumerate(self.terms):
            at = np.searchsorted(terms, wanted)
            at = at[terms[np.minimum(at, len(terms) - 1)] == wanted] if len(terms) else at[:0]
            left = np.cumsum(most[at][::-1])[::-1]
            floor = max(1, int(self.seen[query].min()))
            if not len(at) or left[0] < floor:
                continue
            score = self.accumulate(len(n), [(doc[begins[a] : ends[a]], gain[begins[a] : ends[a]]) for a in at], left, floor)
            best = np.flatnonzero(score >= floor)
            if len(best) > self.k:
                best = best[np.lexsort((order[best], -score[best]))[: self.k]]
            if len(best):
                self.seen[query] = np.partition(np.concatenate([self.seen[query], score[best]]), len(best))[-self.k :]
                out.append((np.full(len(best), query), best, score[best]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def accumulate(self, size: int, lists: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, floor: int) -> np.ndarray:
        """Scores of the documents that have an accumulator, 0 for the others."""
        score = np.zeros(size, np.int64)
        creating = True
        for (doc, gain), rest in zip(lists, left.tolist()):
            if creating and (rest < floor or size >= self.k and rest < np.partition(score, size - self.k)[size - self.k]):
                creating = False
            score[doc] += gain if creating else np.where(score[doc] > 0, gain, 0)
        return score


def _rank(shared, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, total, k = shared.value
        ranker = Ranker(queries, weights, documents, total, k)
        items = pa.array(queries.ids, item_type)
        flat = lambda part: part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name).slice(r, 1) for name in batch.schema.names}
                ids, df = row["id"].flatten(), row["df"].flatten()
                if not len(df):
                    continue
                order = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
                terms, count = (df.field(c).to_numpy().astype(np.int64) for c in ("term", "count"))
                query, best, score = ranker.shard(flat(row["n"]), terms, count, flat(row["doc"]), flat(row["tf"]), order)
                yield pa.RecordBatch.from_arrays([items.take(pa.array(query)), ids.take(pa.array(best)), pa.array(score)], ["item", "id", "score"])

    return run


def _portions(items: DataFrame, item_col: str, text_col: str) -> Iterator[Queries]:
    """Queries in portions; rows of one id are one query with the terms of all of them."""
    text = named(text_col).cast("string")
    parts = (items.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0) // PORTION + 1
    pairs = items.select(named(item_col).alias("id"), F.explode(terms_of(text)).alias("term"))
    pairs = cut_lineage(pairs.distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))))
    for part in range(parts):
        rows = pairs.where(F.col("part") == part).groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        if rows:
            yield Queries.of([(r["id"], r["terms"]) for r in rows])


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``k`` best documents of every query with a score above 0.

    Equal scores go by ascending id; a null id comes last.  Repeated rows of ``docs`` are documents of their own; rows
    of ``items`` with one id (null is an id) are one query with the terms of all of them, each once.  Null and empty
    texts have no terms: such a document is not counted, such a query has no result, as has any query over an empty
    table.  Other columns are not looked at.  A text, however long, is one document of one shard.
    """
    spark = docs.sparkSession
    id_field, item_field = docs.schema[id_col], items.schema[item_col]
    id_type, item_type = to_arrow_type(id_field.dataType), to_arrow_type(item_field.dataType)
    base = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    index_schema = StructType([StructField("id", ArrayType(id_field.dataType)), *StructType.fromDDL(_POSTINGS).fields])
    found_schema = StructType([StructField("item", item_field.dataType), StructField("id", id_field.dataType), StructField("score", LongType())])
    found = []
    for queries in _portions(items, item_col, item_text_col):
        index = cut_lineage(base.mapInArrow(_index(spark.sparkContext.broadcast(queries), id_type), index_schema))
        documents, total = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        weights = np.zeros(len(queries.vocabulary), np.int64)
        for term, holding in index.select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.count")).collect():
            weights[term] = weight(documents, holding)
        model = spark.sparkContext.broadcast((queries, weights, documents, total, k))
        found.append(index.mapInArrow(_rank(model, id_type, item_type), found_schema))
    hits = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], found_schema)
    best = first_rows(hits, ["item"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k, ["id", "score"])
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
