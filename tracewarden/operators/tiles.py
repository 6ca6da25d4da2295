"""Sparse matrices as tiles, multiplied with a table of vectors that is stored once.

Vertices are dealt to ``chunks``; a chunk's vectors are one row of the table of vectors.  The rows of the matrix are
dealt to blocks, each of some whole chunks; all tiles of a block, one a chunk of columns, lie in one partition.  In a
product the task of a block reads the whole table of vectors, a chunk at a time, and adds up its own rows: neither
vectors nor partial sums are shuffled, and what is written is the result.  A task holds the sums of its block, one
chunk and the packed tiles of its block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.session import cut_lineage, release

#: Rows of sums that a task holds, vectors in a chunk, and entries that are sorted at once.
BLOCK, CHUNK, ENTRIES = 1 << 17, 1 << 14, 1 << 22
#: Products of a row and a vector that are held at once.
STEP = 1 << 11


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first bytes of all before the second ones."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return pa.compress(np.ascontiguousarray(planes.T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers by their steps."""
    return packed(np.diff(keys, prepend=keys.dtype.type(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, "<u8"), dtype=np.uint64)


def ipc(**columns) -> bytes:
    """Columns as one compressed batch."""
    batch = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def opened(cell: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(cell.as_buffer()).read_all()


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(values, begin) if len(keys) else values


def add_products(total: np.ndarray, rows: np.ndarray, of: np.ndarray, weight: np.ndarray, m: np.ndarray) -> None:
    """``total[rows] += weight * m[of]`` for entries in the order of their rows."""
    for lo in range(0, len(rows), STEP):
        r = rows[lo : lo + STEP]
        begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        part = m[of[lo : lo + STEP]] * weight[lo : lo + STEP, None]
        total[r[begin]] += part if len(begin) == len(r) else np.add.reduceat(part, begin, axis=0)


def meet(vectors: DataFrame, tiles: DataFrame, chunk: str = "q") -> DataFrame:
    """Every tile with the vectors of its columns: a task a block, the one that holds its tiles.

    Tiles of the chunk -1 hold facts about a block; they come before the others where the table of vectors is read in order.
    """
    first = vectors.sparkSession.range(0, 1, 1, 1).select(F.lit(-1).alias(chunk), *[F.lit(None).cast(t).alias(c) for c, t in vectors.dtypes if c != chunk])
    whole = first.unionByName(vectors).coalesce(1).hint("shuffle_replicate_nl")
    return whole.join(tiles, chunk)


class Grid:
    """``n`` numbered vertices in ``chunks`` of columns and ``blocks`` of rows, each of some whole chunks.

    Vertex ``v`` has place ``v // chunks`` in chunk ``v % chunks``; chunk ``q`` belongs to block ``q % blocks``.
    """

    def __init__(self, n: int, entries: int, least: int, *, block: int = BLOCK, chunk: int = CHUNK, share: int = 1 << 25, most: int = 1 << 30):
        self.n = n
        self.blocks = max(1, -(-n // block), -(-entries // share), min(least, -(-n // 256)))
        self.chunks = self.blocks * max(1, -(-n // (chunk * self.blocks)))
        self.size = max(1, -(-n // self.chunks))  # of a chunk
        self.rows = self.size * (self.chunks // self.blocks)  # of a block
        self.parts = max(1, -(-entries // (self.blocks * 2 * ENTRIES)))  # of a block, for sorting
        # a pass deals out the entries of some blocks only, so that the disk it takes is bounded
        self.passes = min(self.blocks, 16, max(1, -(-entries // most)))

    def part_keys(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part of a block and key in that part, of entries in row ``i`` and column ``j``."""
        qi, qj = i % self.chunks, j % self.chunks
        row = (qi // self.blocks) * self.size + i // self.chunks
        key = ((qj * self.rows + row) * self.size + j // self.chunks).astype(np.uint64)
        return (qi % self.blocks) * self.parts + qj % self.parts, key


def build(entries: Callable[[int, int], DataFrame], grid: Grid, real: bool = False) -> list[DataFrame]:
    """Tiles ``(b, q, n, keys, values)`` of the entries ``(part, n, keys, values)`` that ``entries`` gives for each pass.

    Values of the same row and column are added.  Rows with ``q = -1`` hold the sums over the rows of a part of a block.
    """
    dtype, rows, size, parts = "<f8" if real else "<u8", grid.rows, grid.size, grid.parts

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, n, k, v in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "keys", "values")), strict=True):
                held.setdefault(p, []).append((unpacked_keys(k, n), unpacked(v, n, dtype)))
        for p in list(held):
            some = held.pop(p)
            keys, values = summed(np.concatenate([k for k, _ in some]), np.concatenate([v for _, v in some]))
            del some
            tile = keys // np.uint64(rows * size)
            begin = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            sums = np.zeros(rows)
            for lo, hi in zip(begin, [*begin[1:], len(keys)], strict=True):
                inner, value = keys[lo:hi] - tile[lo] * np.uint64(rows * size), values[lo:hi]
                sums += np.bincount((inner // np.uint64(size)).astype(np.int64), value, rows)
                yield _row(p // parts, int(tile[lo]), hi - lo, packed_keys(inner), packed(value))
            yield _row(p // parts, -1, rows, b"", packed(sums))

    out = []
    for g in range(grid.passes):
        held = len(range(g, grid.blocks, grid.passes))
        block = F.floor(F.col("part") / grid.parts)
        local = F.floor(block / grid.passes) * grid.parts + F.col("part") % grid.parts
        dealt = entries(g, grid.passes).repartitionById(held * grid.parts, local.cast("int"))
        mixed = dealt.mapInArrow(combine, "b int, q int, n long, keys binary, values binary")
        out.append(cut_lineage(mixed.repartitionById(held, F.floor(F.col("b") / grid.passes).cast("int"))))
        release(dealt.sparkSession)
    return out


def _row(*values) -> pa.RecordBatch:
    names = ["b", "q", "n", "keys", "values"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)


class Emitter:
    """Collects entries of one task and gives them, added up and packed, a row a part."""

    def __init__(self, grid: Grid, g: int, passes: int, real: bool = False):
        self.grid, self.g, self.passes, self.real = grid, g, passes, real
        self.held: list[tuple] = []
        self.count = 0

    def add(self, i: np.ndarray, j: np.ndarray, values: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if self.passes > 1:
            mine = i % self.grid.chunks % self.grid.blocks % self.passes == self.g
            i, j, values = i[mine], j[mine], None if values is None else values[mine]
        self.held.append((*self.grid.part_keys(i, j), values))
        self.count += len(i)
        if self.count >= ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        part, keys = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
        # one number sorts by part and key: keys stay under chunks * rows * size
        span = np.uint64(self.grid.chunks * self.grid.rows * self.grid.size)
        joint = part.astype(np.uint64) * span + keys
        if self.real:
            joint, values = summed(joint, np.concatenate([h[2] for h in self.held]))
        else:
            joint.sort()
            first = np.flatnonzero(np.r_[True, joint[1:] != joint[:-1]])
            joint, values = joint[first], np.diff(first, append=len(joint)).astype(np.uint64)
        self.held, self.count = [], 0
        part, keys = joint // span, joint % span
        begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = [*begin[1:], len(part)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(part[lo]) for lo in begin], pa.int32()),
                pa.array([int(hi - lo) for lo, hi in zip(begin, ends, strict=True)], pa.int64()),
                pa.array([packed_keys(keys[lo:hi]) for lo, hi in zip(begin, ends, strict=True)], pa.binary()),
                pa.array([packed(values[lo:hi]) for lo, hi in zip(begin, ends, strict=True)], pa.binary()),
            ],
            names=["part", "n", "keys", "values"],
        )


ENTRY = "part int, n long, keys binary, values binary"


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """The partitions of all, one after the other: Spark would merge those that it sees to be dealt out alike."""
    out = None
    for f in frames:
        f = f.withColumn("b", F.col("b").bitwiseOR(F.lit(0)))
        out = f if out is None else out.unionAll(f)
    return out
