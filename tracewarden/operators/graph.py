"""Interaction graphs as vertex and edge tables, neighbourhood aggregation, walks and embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.functions.maths import ratio
from tracewarden.operators import tiles
from tracewarden.session import cut_lineage, release, stage


def ingest_edges(
    df: DataFrame, src: str, dst: str, *, weight: str | None = None, order: str | None = None, attributes: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, type) and one edge per row (src, dst, weight, attributes).

    Sources are hosts; a destination is typed by its name.  A name seen in both roles keeps the type of
    its first sighting along ``order``, sources first within a row.
    """
    seen = F.col(order) if order else F.lit(0)
    ends = df.select(
        F.explode(
            F.array(
                F.struct(F.col(src).alias("id"), F.lit("host").alias("type"), seen.alias("at"), F.lit(0).alias("side")),
                F.struct(F.col(dst).alias("id"), S.node_type(F.col(dst)).alias("type"), seen.alias("at"), F.lit(1).alias("side")),
            )
        ).alias("v")
    ).select("v.*")
    vertices = ends.groupBy("id").agg(F.min_by("type", F.struct("at", "side")).alias("type"))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    edges = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("weight"), *attributes)
    return vertices, edges


def merge_snapshot(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Snapshot plus a batch: known vertices keep their type, edges accumulate."""
    fresh = new[0].join(old[0].select("id"), "id", "left_anti")
    return old[0].unionByName(fresh), old[1].unionByName(new[1])


def destination_column(df: DataFrame) -> str:
    return "dst_ip" if "dst_ip" in df.columns else "domain"


def simple_undirected(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """One edge per unordered pair, keeping the weight of the last one ingested."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.max_by("weight", F.struct(*order)).alias("weight")
    )


def both_directions(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back.filter("src <> dst"))


def neighbour_means(edges: DataFrame, vectors: DataFrame, hops: int = 2, normalise: bool = True, places: int | None = None) -> DataFrame:
    """Replace each vertex' vector by the mean over its out-neighbours, ``hops`` times, then scale to length 1.

    Vertices are dealt by hash to chunks and blocks.  The edges of a block are written once, counted and packed; in a hop
    the task of a block reads the one copy of all vectors and adds up its own vertices (see ``tiles``), so no vector
    travels along an edge.  Null places of a vector are left out of the sums.  Cells of the result are (id, pos, value).
    """
    spark = edges.sparkSession
    found = vectors.filter("id IS NOT NULL AND vector IS NOT NULL")
    gap = F.max(F.exists("vector", lambda x: x.isNull()))
    width, shortest, gaps, n = found.agg(F.max(F.size("vector")), F.min(F.size("vector")), gap, F.count(F.lit(1))).head()
    linked = edges.filter("dst IS NOT NULL").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    count, sources = linked.agg(F.count(F.lit(1)), F.approx_count_distinct("src")).head()
    if not width or not count:
        return edges.limit(0).select(F.col("src").alias("id"), F.lit(0).alias("pos"), F.lit(0.0).alias("value"))
    ragged = bool(gaps) or shortest != width
    wide = 2 * width if ragged else width  # with gaps, a place that says whether the value is there stands behind each
    blocks = max(1, -(-sources // tiles.BLOCK), -(-count // tiles.ENTRIES), min(spark.sparkContext.defaultParallelism, -(-sources // 256)))
    chunks = blocks * max(1, -(-max(sources, n) // (2 * tiles.CHUNK * blocks)))
    chunk_of = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")
    passes = min(blocks, 8, max(1, -(-count // 100_000_000)))

    def count_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            b = batch.column(2).to_numpy() % blocks
            for one in np.unique(b):
                held.setdefault(int(one), []).append(batch if (b == one).all() else batch.filter(pa.array(b == one)))
        for b in list(held):
            table = pa.Table.from_batches(held.pop(b)).combine_chunks()
            (src, row), (dst, col) = (_coded(table.column(c)) for c in (0, 1))
            of_src, of_dst = np.zeros(len(src), np.int32), np.zeros(len(dst), np.int64)
            of_src[row], of_dst[col] = table.column(2).to_numpy(), table.column(3).to_numpy()
            del table
            key, times = np.unique(row * len(dst) + col, return_counts=True)
            row, col = key // len(dst), key % len(dst)
            order = np.argsort(of_dst[col], kind="stable")  # by chunk, then row
            row, col, times = row[order], col[order], times[order]
            yield _tile(b, -1, len(src), tiles.ipc(id=src, q=of_src), b"")
            begin = np.flatnonzero(np.r_[True, np.diff(of_dst[col]) != 0])
            for lo, hi in zip(begin, [*begin[1:], len(col)], strict=True):
                names, at = np.unique(col[lo:hi], return_inverse=True)
                tile = tiles.ipc(row=row[lo:hi].astype(np.int32), col=at.astype(np.int32), times=times[lo:hi])
                yield _tile(b, int(of_dst[col[lo]]), len(src), tiles.ipc(id=dst.take(pa.array(names))), tile)

    dealt = linked.select("src", "dst", chunk_of("src").alias("sq"), chunk_of("dst").alias("dq"))
    cells = []
    for g in range(passes):
        block = F.col("sq") % blocks
        mine = dealt.filter(block % passes == g).repartitionById(len(range(g, blocks, passes)), F.floor(block / passes).cast("int"))
        cells.append(cut_lineage(mine.mapInArrow(count_edges, "b int, q int, n long, names binary, tile binary")))
        release(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            q, m = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, wide)
            for one in np.unique(q):
                held.setdefault(int(one), []).append((batch.column(1).filter(pa.array(q == one)), m[q == one]))
        for q in list(held):
            some = held.pop(q)
            ids, at = _coded(pa.chunked_array([i for i, _ in some]))
            m, times = np.concatenate([v for _, v in some]), np.bincount(at, minlength=len(ids))
            order = np.argsort(at, kind="stable")
            m = m[order]
            if len(ids) < len(at):  # a vertex with several vectors counts as often
                m = np.add.reduceat(m.astype(np.float64), np.r_[0, np.cumsum(times)[:-1]], axis=0)
            yield _means(q, ids, m, times)

    value = F.col("vector")
    if ragged:
        whole = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.col("vector"), i).cast("double"))
        value = F.concat(F.transform(whole, lambda x: F.coalesce(x, F.lit(0.0))), F.transform(whole, lambda x: x.isNotNull().cast("double")))
    elif found.schema["vector"].dataType.elementType.typeName() not in ("float", "double"):
        value = value.cast("array<double>")
    named = found.select(F.col("id").cast("string").alias("id"), value.alias("vector"))
    now = named.select(chunk_of("id").alias("q"), "id", "vector").repartitionById(blocks, (F.col("q") % blocks).cast("int")).mapInArrow(pack, MEANS)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        rows: dict[int, pa.Table] = {}
        last, known, m = None, None, None
        for batch in batches:
            for q, names, v, real, times, b, n, of, tile in zip(*batch.columns, strict=True):
                q, b = q.as_py(), b.as_py()
                if q < 0:
                    rows[b] = tiles.opened(of)
                    continue
                if q != last:
                    last, known, there = q, tiles.opened(names).column("id").combine_chunks(), np.frombuffer(times.as_buffer(), "<f8")
                    m = np.column_stack([np.frombuffer(v.as_buffer(), "<f8" if real.as_py() else "<f4").reshape(-1, wide).astype(np.float64), there])
                entries = tiles.opened(tile)
                met = pc.index_in(tiles.opened(of).column("id").combine_chunks(), value_set=known).fill_null(-1).to_numpy()
                row, at, weight = (entries.column(c).to_numpy() for c in ("row", "col", "times"))
                at = met[at]
                if (at < 0).any():
                    row, at, weight = row[at >= 0], at[at >= 0], weight[at >= 0]
                if b not in total:
                    total[b] = np.zeros((n.as_py(), wide + 1))
                tiles.add_products(total[b], row, at, weight, m)
        for b in list(total):
            sums, ids, of = total.pop(b), rows[b].column("id").combine_chunks(), rows[b].column("q").to_numpy()
            for q in np.unique(of):
                mine = np.flatnonzero((of == q) & (sums[:, -1] > 0))
                if len(mine):
                    part = sums[mine]
                    part[:, :width] /= part[:, -1:]
                    part[:, width:] = part[:, width:] > 0
                    yield _means(int(q), ids.take(pa.array(mine)), part[:, :wide], np.ones(len(mine)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, names, v, real, _ in zip(*batch.columns, strict=True):
                ids, m = tiles.opened(names).column("id").combine_chunks(), np.frombuffer(v.as_buffer(), "<f8" if real.as_py() else "<f4").reshape(-1, wide).astype(np.float64)
                for lo in range(0, len(m), 4096):
                    part = m[lo : lo + 4096]
                    gone = (part[:, width:] == 0).ravel() if ragged else None
                    a = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, pa.array(np.ascontiguousarray(part[:, :width]).ravel(), mask=gone))
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), a], names=["id", "a"])

    whole = tiles.union(cells).withColumnRenamed("names", "of")
    now = cut_lineage(now)
    for hop in range(hops):
        met = tiles.meet(now, whole).select("q", "names", "v", "real", "times", "b", "n", "of", "tile").mapInArrow(mean, MEANS)
        if hop < hops - 1:
            met = cut_lineage(met)
            release(spark, now)
        now = met
    means = now.mapInArrow(rows, "id string, a array<double>").select(F.col("id").cast(edges.schema["src"].dataType).alias("id"), "a")
    if normalise:
        norm = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))
        means = means.withColumn("_n", norm).select("id", F.transform("a", lambda x: ratio(x, F.col("_n"))).alias("a"))
    means = means.select("id", F.posexplode("a").alias("pos", "value"))
    return means if places is None else means.withColumn("value", F.round("value", places))


MEANS = "q int, names binary, v binary, real boolean, times binary"


def _means(q: int, ids: pa.Array, m: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """A chunk of named vectors, and how often each counts."""
    m = np.ascontiguousarray(m)
    cells = [tiles.ipc(id=ids), m.tobytes(), m.itemsize == 8, times.astype(np.float64).tobytes()]
    types = [pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), *[pa.array([c], t) for c, t in zip(cells, types, strict=True)]], names=["q", "names", "v", "real", "times"])


def _tile(b: int, q: int, n: int, names: bytes, tile: bytes) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((b, q, n, names, tile), types, strict=True)], names=["b", "q", "n", "names", "tile"])


def _coded(names: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct names, null among them, and the place of each row's."""
    coded = pc.dictionary_encode(names, null_encoding="encode").combine_chunks()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def stable_hash(*columns, seed: int = 0):
    """Replayable pseudo-random 31-bit number, from md5 so any engine can repeat it."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def sample_neighbours(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most ``k`` distinct out-neighbours per vertex, chosen by hash order (a sampling operator).

    Spark limits every map task to ``k`` rows per vertex before the shuffle, so a hub arrives as ``k`` rows
    per task.
    """
    ranked = edges.select("src", "dst").distinct().withColumn("_h", stable_hash("src", "dst", seed=seed))
    w = Window.partitionBy("src").orderBy("_h", "dst")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("src", "dst", "rank")


def sample_tree(edges: DataFrame, fanouts: Sequence[int] = (15, 10), seed: int = 0) -> DataFrame:
    """Sampled neighbours of every vertex, layer by layer: (root, hop, path array from the root to the neighbour).

    Hop h follows at most ``fanouts[h - 1]`` out-neighbours of each vertex reached by the hop before.  A layer has
    draws of its own, which a vertex keeps whatever root it is reached from; so a hub enters the join of a layer
    with its sample, never with all its neighbours.
    """
    layer, out = None, None
    for hop, k in enumerate(fanouts, 1):
        drawn = sample_neighbours(edges, k, seed + hop - 1).select("src", "dst")
        if layer is None:
            layer = drawn.select(F.col("src").alias("root"), F.array("src", "dst").alias("path"))
        else:
            layer = layer.join(drawn, F.element_at("path", -1) == F.col("src")).select("root", F.concat("path", F.array("dst")).alias("path"))
        one = layer.select("root", F.lit(hop).alias("hop"), "path")
        out = one if out is None else out.unionByName(one)
    return out


def drop_edges(edges: DataFrame, rate: float, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """Seeded edge dropout: the same edges are dropped on every replay."""
    return edges.filter(stable_hash(*columns, seed=seed) % 1000 >= int(round(rate * 1000)))


def centroid(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    cells = vectors.select(F.posexplode(vector).alias("pos", "value"))
    return cells.groupBy("pos").agg(F.avg(F.col("value").cast("double")).alias("value"))


def embedding_drift(baseline: DataFrame, current: DataFrame, vector: str = "vector", threshold: float = 0.5) -> DataFrame:
    """Distance between mean vectors and whether it exceeds the threshold, as one row."""
    a, b = centroid(baseline, vector), centroid(current, vector).withColumnRenamed("value", "now")
    d = F.sqrt(F.sum(F.pow(F.col("now") - F.col("value"), 2)))
    return a.join(b, "pos").agg(d.alias("drift")).withColumn("drifted", F.col("drift") > threshold)


def sequences(windows: DataFrame, entity: str, order: str, value: str, length: int = 24) -> DataFrame:
    """The last ``length`` windows of an entity as an array per window.

    Windows are one row per entity and bucket, so a partition is bounded by the length of the time line.
    """
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-(length - 1), 0)
    return windows.withColumn("sequence", F.collect_list(value).over(w))


def random_walks(edges: DataFrame, *, walks: int = 10, length: int = 40, seed: int = 7, cut_every: int = 8) -> DataFrame:
    """Uniform random walks as (walk, start, path array) over the undirected graph.

    All walks advance together: one equi-join per step on (vertex, index of the neighbour), so a hub is spread over
    its neighbours' indexes; every neighbour row carries its own degree for the next draw.  Draws are md5 values of
    start, walk, step and seed, so any engine can repeat them.  Lineage is cut every few steps.
    """
    linked = both_directions(edges.select("src", "dst").distinct()).distinct()
    from tracewarden.operators.scale import prefix_sums

    # number every vertex' neighbours without gathering them
    numbered = prefix_sums(linked, ["src"], ["dst"], {"at": F.lit(1)}, totals=True).select(
        F.col("src").alias("node"), (F.col("at") - 1).cast("long").alias("at"), F.col("dst").alias("next"), F.col("at_total").alias("degree")
    )
    numbered = cut_lineage(numbered)
    degrees = numbered.filter("at = 0").select("node", "degree")
    steps = cut_lineage(numbered.select("node", "at", "next").join(degrees.withColumnsRenamed({"node": "next"}), "next"))
    state = degrees.select(F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.col("node").alias("start"), "node", "degree", F.array("node").alias("path"))
    for step in range(1, length):
        drawn = state.withColumn("at", stable_hash("start", "walk", F.lit(step), seed=seed) % F.col("degree")).drop("degree")
        state = drawn.join(steps, ["node", "at"]).select(
            "walk", "start", F.col("next").alias("node"), "degree", F.concat("path", F.array("next")).alias("path")
        )
        if step % cut_every == 0:
            state = cut_lineage(state)
    return state.select("walk", "start", "path")


def co_occurrences(walks: DataFrame, window: int = 5) -> DataFrame:
    """How often two vertices stand at most ``window`` steps apart on a walk: (src, dst, n), both ways round.

    Pairs are counted before they are shuffled; a walk gives at most ``2 * window`` of them a step.
    """
    steps = walks.select("path", F.posexplode("path").alias("at", "src"))
    near = F.concat(
        F.slice("path", F.greatest(F.col("at") + 1 - window, F.lit(1)), F.least(F.col("at"), F.lit(window))),
        F.slice("path", F.col("at") + 2, F.lit(window)),
    )
    return steps.select("src", F.explode(near).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def positive_information(pairs: DataFrame) -> DataFrame:
    """Positive pointwise mutual information of co-occurrence counts: (src, dst, weight), cells above 0 only.

    A vertex' total is added to its cells by a join, so a hub's cells stay spread.
    """
    totals = pairs.groupBy("src").agg(F.sum("n").alias("_of"))
    whole = totals.agg(F.sum("_of").cast("double")).scalar()
    weight = F.log(F.col("n") * whole / (F.col("_of").cast("double") * F.col("_to")))
    met = pairs.join(totals, "src").join(totals.select(F.col("src").alias("dst"), F.col("_of").alias("_to")), "dst")
    return met.select("src", "dst", weight.alias("weight")).filter(F.col("weight") > 0)


def _gram(blocks: DataFrame, left: str, right: str, r: int) -> np.ndarray:
    """Sum over all rows of the outer product of two vectors of length ``r``: that many numbers squared reach the driver.

    Each task gives one matrix; they are added in two steps.
    """
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r, r))
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                total += _matrix(x, r).T @ _matrix(y, r)
        yield pa.RecordBatch.from_arrays([pa.array([int(TaskContext.get().partitionId()) % 64], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["group", "m"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": [0], "m": [np.sum(np.stack(part["m"].to_numpy()), axis=0)]})

    parts = blocks.select(F.col(left), F.col(right).alias("_right")).mapInArrow(outer, "group int, m array<double>")
    whole = parts.groupBy("group").applyInPandas(add, parts.schema).groupBy("group").applyInPandas(add, parts.schema).head()
    return np.zeros((r, r)) if whole is None else np.asarray(whole["m"]).reshape(r, r)


def _matrix(cell: pa.Scalar, width: int) -> np.ndarray:
    """The vectors of a chunk."""
    return np.frombuffer(cell.as_buffer(), "<f8").reshape(-1, width)


def _times(chunks: DataFrame, vector: str, small: np.ndarray) -> DataFrame:
    """``(q, v, t)`` of the vectors of chunks multiplied from the right by a small matrix."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v, t in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                yield _chunk(q.as_py(), _matrix(v, len(small)) @ small, t.as_py())

    return chunks.select("q", vector, "t").mapInArrow(multiply, CHUNKS)


CHUNKS = "q int, v binary, t binary"


def _chunk(q: int, v: np.ndarray, t: bytes | np.ndarray) -> pa.RecordBatch:
    """A row of the table of vectors: a chunk's vectors and the totals of its vertices."""
    cells = [pa.array([q], pa.int32()), *[pa.array([x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (v, t)]]
    return pa.RecordBatch.from_arrays(cells, names=["q", "v", "t"])


def _root(gram: np.ndarray) -> np.ndarray:
    """Inverse root of a Gram matrix; directions that the rows do not span become 0."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > values[-1] * 1e-12 if values[-1] > 0 else np.zeros(len(values), bool)
    return vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def _started(ids: DataFrame, grid: tiles.Grid, r: int, seed: int) -> DataFrame:
    """Chunks of starting vectors, from the vertices' md5."""
    start = F.array(*[stable_hash("id", F.lit(k), seed=seed) / float(1 << 27) - 1.0 for k in range(r)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            at, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, r)
            for q in np.unique(at % grid.chunks):
                mine = at % grid.chunks == q
                held.setdefault(int(q), []).append((at[mine], v[mine]))
        for q in list(held):
            some = held.pop(q)
            order = np.argsort(np.concatenate([a for a, _ in some]))
            yield _chunk(q, np.concatenate([v for _, v in some])[order], b"")

    block = (F.col("at") % grid.chunks % grid.blocks).cast("int")
    return ids.select("at", start.alias("v")).repartitionById(grid.blocks, block).mapInArrow(pack, CHUNKS)


def _product(vectors: DataFrame, cells: DataFrame, grid: tiles.Grid, r: int, whole: float | None) -> DataFrame:
    """Chunks of the matrix' product with the vectors; entries are weights, or counts that stand for information.

    ``whole`` is the sum of all counts, ``t`` the totals of a chunk's vertices.
    """
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for q, v, t, b, n, keys, values in zip(*batch.columns, strict=True):
                q, b, n = q.as_py(), b.as_py(), n.as_py()
                if q < 0:
                    sums[b] = sums.get(b, 0) + tiles.unpacked(values.as_buffer(), n, "<f8")
                    continue
                if b not in sums:
                    raise RuntimeError("a block's totals must be read before its tiles")
                key = tiles.unpacked_keys(keys.as_buffer(), n).astype(np.int64)
                row, of = key // grid.size, key % grid.size
                if whole is None:
                    weight = tiles.unpacked(values.as_buffer(), n, "<f8")
                else:
                    count, to = tiles.unpacked(values.as_buffer(), n, "<u8"), np.frombuffer(t.as_buffer(), "<f8")
                    weight = np.log(count * whole / (sums[b][row] * to[of]))
                    above = weight > 0
                    row, of, weight = row[above], of[above], weight[above]
                tiles.add_products(total.setdefault(b, np.zeros((grid.rows, r))), row, of, weight, _matrix(v, r))
        for b in sums:
            found = total.pop(b, None)
            found = np.zeros((grid.rows, r)) if found is None else found
            for k, q in enumerate(range(b, grid.chunks, grid.blocks)):
                of = slice(k * grid.size, k * grid.size + len(range(q, grid.n, grid.chunks)))
                yield _chunk(q, found[of], sums[b][of])

    return tiles.meet(vectors, cells).select("q", "v", "t", "b", "n", "keys", "values").mapInArrow(multiply, CHUNKS)


def _totals(cells: DataFrame, grid: tiles.Grid) -> DataFrame:
    """``(q, t)``: the sums over the rows of the matrix, a chunk a row."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n, values in zip(*batch.columns, strict=True):
                sums[b.as_py()] = sums.get(b.as_py(), 0) + tiles.unpacked(values.as_buffer(), n.as_py(), "<f8")
        for b, t in sums.items():
            for k, q in enumerate(range(b, grid.chunks, grid.blocks)):
                yield _chunk(q, b"", t[k * grid.size : k * grid.size + len(range(q, grid.n, grid.chunks))])

    return cells.filter("q < 0").select("b", "n", "values").mapInArrow(add, CHUNKS).select("q", "t")


def _factors(ids: DataFrame, cells: list[DataFrame], grid: tiles.Grid, dim: int, *, rounds: int, spare: int, seed: int, counts: bool) -> DataFrame:
    """``(id, vector, total)``: the leading eigenvectors of a symmetric matrix in tiles, scaled by the root of their
    absolute value, by randomised subspace iteration; and the sum over the row."""
    spark, r = ids.sparkSession, dim + spare
    whole_of = tiles.union(cells)
    totals = cut_lineage(_totals(whole_of, grid))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([float(sum(np.frombuffer(t.as_buffer(), "<f8").sum() for batch in batches for t in batch.column(0)))])], names=["n"])

    whole = totals.select("t").mapInArrow(add, "n double").agg(F.sum("n")).head()[0] if counts else None
    base = cut_lineage(_started(ids, grid, r, seed).drop("t").join(totals, "q").select("q", "v", "t"))
    product = lambda vectors: _product(vectors, whole_of, grid, r, whole)
    for _ in range(rounds):
        image = cut_lineage(product(base))
        release(spark, base)
        base = cut_lineage(_times(image, "v", _root(_gram(image, "v", "v", r))))
        release(spark, image)
    image = cut_lineage(product(base))
    release(spark, totals, *cells)
    small = _gram(base.join(image.select("q", F.col("v").alias("image")), "q"), "v", "image", r)
    release(spark, image)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(-np.abs(values), kind="stable")[:dim]
    found = _times(base, "v", turn[:, lead] * np.sqrt(np.abs(values[lead])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v, t in zip(*batch.columns, strict=True):
                m, t = _matrix(v, dim), np.frombuffer(t.as_buffer(), "<f8")
                for lo in range(0, len(m), 4096):
                    part = m[lo : lo + 4096]
                    at = (np.arange(lo, lo + len(part)) * grid.chunks + q.as_py()).astype(np.int64)
                    vector = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * dim, np.ascontiguousarray(part).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(at), vector, pa.array(t[lo : lo + 4096])], names=["at", "vector", "total"])

    return found.mapInArrow(rows, "at long, vector array<double>, total double").join(ids, "at").select("id", "vector", "total")


def _numbered(names: DataFrame) -> DataFrame:
    """``(id, at)`` of distinct names, numbered from 0 in their order."""
    from tracewarden.operators.scale import prefix_sums

    return cut_lineage(prefix_sums(names, [], ["id"], {"at": F.lit(1)}).select("id", (F.col("at") - 1).cast("long").alias("at")))


def spectral_embedding(cells: DataFrame, dim: int = 64, *, rounds: int = 6, spare: int = 16, seed: int = 7, block: int = 16_384) -> DataFrame:
    """Vectors of a symmetric sparse matrix ``src, dst, weight``: (id, vector), the leading ``dim`` eigenvectors scaled by
    the root of their absolute value, by randomised subspace iteration.

    The matrix is written once as packed tiles.  A round multiplies it with chunks of at most ``block`` vectors, which are
    written once a round and read by the task of each block of rows (see ``tiles``).  Products of ``dim + spare`` columns are
    summed to a small matrix.  Starting vectors come from the vertex' md5, so a run can be repeated.  With fewer vertices
    than ``dim`` the rest of a vector is 0; vertices without a cell are not in the result.
    """
    spark = cells.sparkSession
    named = cells.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
    ids = _numbered(named.select(F.col("src").alias("id")).filter("id IS NOT NULL").distinct())
    n = ids.count()
    if not n:
        return ids.select("id", F.array().cast("array<double>").alias("vector"))
    side = lambda c: ids.select(F.col("id").alias(c), F.col("at").alias(f"{c}_at"))
    known, path = stage(named.join(side("src"), "src").join(side("dst"), "dst").select("src_at", "dst_at", "weight"))
    grid = tiles.Grid(n, known.count(), spark.sparkContext.defaultParallelism, chunk=block)

    def deal(g: int, passes: int) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = tiles.Emitter(grid, g, passes, real=True)
            for batch in batches:
                yield from held.add(*[batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            yield from held.flush()

        return known.mapInArrow(emit, tiles.ENTRY)

    built = tiles.build(deal, grid, real=True)
    release(spark, path)
    return _factors(ids, built, grid, dim, rounds=rounds, spare=spare, seed=seed, counts=False).select("id", "vector")


def numbered_walks(edges: DataFrame, *, walks: int, length: int, seed: int, overlap: int, cut_every: int = 5) -> tuple[DataFrame, int, list[tuple[DataFrame, int, int]], list[str]]:
    """The walks of ``random_walks`` in numbers: the vertices ``(id, at)`` and how many there are, the walks in pieces
    ``(rows, vertices, of these new)``, and the paths to release.

    What is written at a cut is a piece; a walk goes on from the last ``overlap`` vertices of it, so no row ever carries a
    whole path.
    """
    from tracewarden.operators.scale import prefix_sums

    spark = edges.sparkSession
    linked, links = stage(both_directions(edges.select("src", "dst").distinct()).distinct())
    ids = _numbered(linked.select(F.col("src").alias("id")).filter("id IS NOT NULL").distinct())
    n = ids.count()
    side = lambda c: ids.select(F.col("id").alias(c), F.col("at").alias(f"{c}_at"))
    # numbers stand in the order of the names, so neighbours keep their indexes; one without a name is counted, first
    paired = linked.join(side("src"), "src").join(side("dst"), "dst", "left").select(F.col("src_at").alias("node"), F.col("dst_at").alias("next"))
    indexed = prefix_sums(paired, ["node"], ["next"], {"i": F.lit(1)}, totals=True)
    numbered, table = stage(indexed.select("node", "next", (F.col("i") - 1).cast("long").alias("i"), F.col("i_total").cast("long").alias("degree")))
    degrees = numbered.filter("i = 0").select("node", "degree")
    dealt = numbered.select("node", "i", "next").join(degrees.withColumnRenamed("node", "next"), "next")
    steps = cut_lineage(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node", "i"))
    lost = bool(numbered.filter("next IS NULL").head(1))
    state = cut_lineage(ids.join(degrees.withColumnRenamed("node", "at"), "at").select("id", F.col("at").alias("node"), "degree"))
    release(spark, links, table)
    begun = state
    number = lambda c: F.array(F.col(c).cast("int" if n < 1 << 31 else "long"))
    state = state.select("id", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), "node", "degree", number("node").alias("path"))
    pieces, paths, have, fresh = [], [], 1, 1
    for step in range(1, length):
        drawn = state.withColumn("i", stable_hash("id", "walk", F.lit(step), seed=seed) % F.col("degree")).drop("degree")
        state = drawn.join(steps, ["node", "i"]).select("id", "walk", F.col("next").alias("node"), "degree", F.concat("path", number("next")).alias("path"))
        have, fresh = have + 1, fresh + 1
        if step % cut_every == 0 or step == length - 1:
            state, path = stage(state)
            pieces.append((state, have, fresh))
            paths.append(path)
            have, fresh = min(have, overlap), 0
            state = state.withColumn("path", F.slice("path", -have, have))
            release(spark)
    release(spark, begun, steps)
    if lost and pieces:  # a walk that comes to a neighbour without a name is not in the result
        whole = pieces[-1][0].select("id", "walk")
        pieces = [(p.join(whole, ["id", "walk"], "left_semi"), h, f) for p, h, f in pieces[:-1]] + pieces[-1:]
    return ids, n, pieces, paths


def _near(piece: DataFrame, have: int, fresh: int, window: int, grid: tiles.Grid, g: int, passes: int) -> DataFrame:
    """Entries of the pairs that stand at most ``window`` steps apart in a piece of the walks, the later one new; both ways round."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tiles.Emitter(grid, g, passes)
        for batch in batches:
            m = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, have)
            for k in range(1, min(window, have - 1) + 1):
                lo = max(have - fresh, k)
                one, other = m[:, lo:].ravel(), m[:, lo - k : have - k].ravel()
                yield from held.add(np.r_[one, other], np.r_[other, one])
        yield from held.flush()

    return piece.select("path").mapInArrow(emit, tiles.ENTRY)


def walk_embeddings(edges: DataFrame, *, dim: int = 64, walks: int = 10, length: int = 40, window: int = 5, seed: int = 7) -> DataFrame:
    """Embeddings (id, vector) of all vertices from random walks.

    Instead of sampling skip-gram steps, the matrix that these approach is built whole (positive pointwise mutual
    information of the walks' co-occurrences) and factorised.  Every vertex of an edge is in the result; one that
    meets all others as often as chance would has a vector of zeros.

    The walks are those of ``random_walks`` and the counts those of ``co_occurrences``, both in numbers; the matrix is kept
    as packed tiles of counts, which a product turns into the weights of ``positive_information``.
    """
    spark = edges.sparkSession
    ids, n, pieces, paths = numbered_walks(edges, walks=walks, length=length, seed=seed, overlap=window)
    if not pieces or not n:
        return ids.limit(0).select(F.col("id").cast("string").alias("id"), F.array_repeat(F.lit(0.0), dim).alias("vector"))
    pairs = 2 * n * walks * sum(max(0, length - k) for k in range(1, window + 1))
    grid = tiles.Grid(n, pairs, spark.sparkContext.defaultParallelism)

    def deal(g: int, passes: int) -> DataFrame:
        out = None
        for piece, have, fresh in pieces:
            near = _near(piece, have, fresh, window, grid, g, passes)
            out = near if out is None else out.unionAll(near)
        return out

    counts = tiles.build(deal, grid)
    release(spark, *paths)
    found = _factors(ids, counts, grid, dim, rounds=6, spare=16, seed=seed, counts=True)
    return found.filter("total > 0").select(F.col("id").cast("string").alias("id"), "vector")
