"""Which anchors a greedy grouping visits, by list ranking over slices.

A group starts at its anchor and the next one is determined by it alone, so the anchors of a key are a path in a forest
in which every row has one successor.  ``entry_anchors`` walks that path without ever walking a key:

1. every slice reports one row for its first and its last key: size, first and last time, and the anchor left open if
   the key began there (``borders``).  What a key sends is one row a slice, however dense the slice is;
2. a key of two slices is done then.  For a longer one the slices between report the anchors that *some* entry would
   leave open (``open_anchors``), and each of them finds its successor: its end falls into one later slice, known from
   the borders, and only there, in the rows of that one slice, it is looked up;
3. these links are doubled by joins, as often as the logarithm of the number of slices, and the anchors that are
   reached from a key's beginning are marked with the doubled links, the longest first.

Links stay in tables spread by key, slice and row.  The driver sees the borders and the visited anchors, at most one
row a slice and key of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.session import cut_lineage

ENTRIES = "slice_id int, fold_key string, in_anchor bigint, in_seq bigint"
# ``anchor`` only counts where ``open``: a group that ended with its slice leaves none
_BORDERS = "slice_id int, fold_key string, n bigint, last_us bigint, row bigint, open boolean, anchor bigint"
_NODES = "fold_key string, slice_id int, row bigint, open boolean, anchor bigint"
_LINKS = "fold_key string, slice_id int, row bigint, to_slice int, to_row bigint, to_open boolean, to_anchor bigint"


def successors(t: np.ndarray, span: int, closes: bool) -> np.ndarray:
    """For each row of a slice, taken as an anchor, the row that starts the next group.

    A row whose group does not end in the slice leads to itself.  Entry ``len(t)`` stands for "the last group ended
    with the slice's last row" and leads to itself too.
    """
    m, own = len(t), np.arange(len(t))
    if closes:
        end = np.maximum(np.searchsorted(t, t + span, "left"), own)
        after = end + 1
    else:
        end = after = np.searchsorted(t, t + span, "right")
    return np.append(np.where(end == m, own, after), m)


def last_anchors(t: np.ndarray, span: int, closes: bool) -> np.ndarray:
    """For each row at which a group starts, the anchor that is open at the slice's end (``len(t)``: none is)."""
    to = successors(t, span, closes)
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def entry_rows(t: np.ndarray, span: int, closes: bool, anchors: np.ndarray) -> np.ndarray:
    """Row of a slice that starts the group after that of an earlier anchor, which ends in the slice."""
    return np.searchsorted(t, anchors + span, "left") + 1 if closes else np.searchsorted(t, anchors + span, "right")


def open_anchors(t: np.ndarray, span: int, closes: bool) -> np.ndarray:
    """Rows that are left open at the end of a slice by some entry: entries lie within a span of its first row."""
    reach = min(len(t), int(np.searchsorted(t, t[0] + span, "right")) + 1)
    return np.unique(last_anchors(t, span, closes)[: reach + 1])


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    if len(keys):
        yield from zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True)


def _borders(order_col: str, walk: Callable) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slice_id, key, rows = None, None, []
        anchor, seq, n, last = None, 0, 0, 0

        def row():
            return slice_id, key, n, last, *((n - seq, True, anchor) if anchor is not None else (n, False, 0))

        for b in batches:
            keys, times = b["fold_key"].to_numpy(), b[order_col].to_numpy(np.int64)
            for lo, hi in _runs(keys):
                if keys[lo] != key:
                    if key is not None and not rows:
                        rows.append(row())
                    slice_id, key = int(b["slice_id"].iloc[0]), keys[lo]
                    anchor, seq, n = None, 0, 0
                _, _, anchor, seq = walk(times[lo:hi], anchor, seq)
                n, last = n + int(hi - lo), int(times[hi - 1])
        if key is not None:
            rows.append(row())
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BORDERS.split(", ")])

    return run


def _nodes(order_col: str, span: int, closes: bool) -> Callable:
    """Anchors that may be left open by slices that one key fills and runs through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, slice_id, key = [], None, None
        for b in batches:
            if len(b):
                slice_id, key = int(b["slice_id"].iloc[0]), b["fold_key"].iloc[0]
                seen.append(b[order_col].to_numpy(np.int64))
        if seen:
            t = np.concatenate(seen)
            at = open_anchors(t, span, closes)
            yield pd.DataFrame({"fold_key": key, "slice_id": np.int32(slice_id), "row": at, "open": at < len(t), "anchor": t[np.minimum(at, len(t) - 1)]})

    return run


class Path:
    """The slices of a key that has several: their numbers, sizes and last times."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["slice_id"])
        self.slices = np.array([r["slice_id"] for r in rows])
        self.last = np.array([r["last_us"] for r in rows])
        self.before = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
        self.head = rows[0]

    def target(self, slice_id: int, is_open: bool, anchor: int, span: int, closes: bool) -> int | None:
        """Place in the path of the slice in which the anchor's group ends, or that begins anew; None: it stays open."""
        at = int(np.searchsorted(self.slices, slice_id)) + 1
        if not is_open:
            return at
        # last times never fall along a path
        at = max(at, int(np.searchsorted(self.last, anchor + span, "left" if closes else "right")))
        return at if at < len(self.slices) else None


def _probe(paths, span: int, closes: bool) -> Callable:
    """The slice in which each node's successor is, if another one follows it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            to = []
            for r in b.itertuples(index=False):
                path = paths.value[r.fold_key]
                at = path.target(r.slice_id, r.open, r.anchor, span, closes)
                to.append(-1 if at is None or at == len(path.slices) - 1 else int(path.slices[at]))
            b = b.assign(to_slice=np.array(to, np.int32))
            yield b[b["to_slice"] >= 0]

    return run


def _resolve(order_col: str, span: int, closes: bool) -> Callable:
    def run(probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = probes[["fold_key", "slice_id", "row", "to_slice"]]
        if not len(probes):
            return found.assign(to_row=0, to_open=False, to_anchor=0)
        t = np.sort(rows[order_col].to_numpy(np.int64))
        known = probes["open"].to_numpy()
        at = np.zeros(len(probes), np.int64)  # after a group that ended with its slice the next one starts with this one
        at[known] = entry_rows(t, span, closes, probes["anchor"].to_numpy()[known])
        row = last_anchors(t, span, closes)[at]
        return found.assign(to_row=row, to_open=row < len(t), to_anchor=t[np.minimum(row, len(t) - 1)])

    return run


def _links(cut: DataFrame, order_col: str, span: int, closes: bool, paths: dict[str, Path], heads: DataFrame) -> DataFrame:
    """The successor of every anchor that may be left open, where that lies in a slice that the key runs through."""
    context = cut.sparkSession.sparkContext
    between = sorted({int(s) for p in paths.values() for s in p.slices[1:-1]})
    through = cut.where(F.col("slice_id").isin(between)).select("slice_id", "fold_key", F.col(order_col).cast("long").alias(order_col))
    nodes = heads.unionByName(through.mapInPandas(_nodes(order_col, span, closes), _NODES))
    probes = nodes.mapInPandas(_probe(context.broadcast(paths), span, closes), _NODES + ", to_slice int")
    wanted = probes.groupBy("to_slice", "fold_key")
    there = through.withColumnRenamed("slice_id", "to_slice").groupBy("to_slice", "fold_key")
    run = _resolve(order_col, span, closes)
    return cut_lineage(wanted.cogroup(there).applyInPandas(run, _LINKS))


def _visited(links: DataFrame, heads: DataFrame, longest: int) -> DataFrame:
    """Nodes that can be reached from ``heads``; no chain has more than ``longest`` of them."""
    jumps = [links]
    while 1 << len(jumps) < longest:
        first, then = jumps[-1], jumps[-1].select("fold_key", F.col("slice_id").alias("to_slice"), F.col("row").alias("to_row"), F.col("to_slice").alias("s"), F.col("to_row").alias("r"), "to_open", "to_anchor")
        doubled = first.drop("to_open", "to_anchor").join(then, ["fold_key", "to_slice", "to_row"])
        jumps.append(cut_lineage(doubled.select("fold_key", "slice_id", "row", F.col("s").alias("to_slice"), F.col("r").alias("to_row"), "to_open", "to_anchor")))
    seen = heads
    for jump in reversed(jumps):
        reached = seen.select("fold_key", "slice_id", "row").join(jump, ["fold_key", "slice_id", "row"])
        seen = cut_lineage(seen.unionByName(reached.select("fold_key", F.col("to_slice").alias("slice_id"), F.col("to_row").alias("row"), F.col("to_open").alias("open"), F.col("to_anchor").alias("anchor"))))
    return seen


def entry_anchors(cut: DataFrame, order_col: str, span: int, *, closes: bool, walk: Callable) -> DataFrame:
    """``(slice_id, fold_key, in_anchor, in_seq)`` for every slice that a key enters with an open group.

    ``cut`` has ``slice_id`` and ``fold_key``; ``walk(times, anchor, seq)`` labels rows of one key in order and gives
    the anchor left open and its group's size last.
    """
    spark = cut.sparkSession
    borders = cut.select("slice_id", "fold_key", F.col(order_col).cast("long").alias(order_col)).mapInPandas(_borders(order_col, walk), _BORDERS)
    of_key = defaultdict(list)
    for r in borders.collect():
        of_key[r["fold_key"]].append(r)
    paths = {key: Path(rows) for key, rows in of_key.items() if len(rows) > 1}
    head = lambda key: (key, *(paths[key].head[c] for c in ("slice_id", "row", "open", "anchor")))
    visited = [head(key) for key in paths]
    long = {key: path for key, path in paths.items() if len(path.slices) > 2}
    if long:
        heads = spark.createDataFrame([head(key) for key in long], _NODES)
        links = _links(cut, order_col, span, closes, long, heads)
        visited = [v for v in visited if v[0] not in long] + [tuple(r) for r in _visited(links, heads, max(len(p.slices) for p in long.values())).collect()]
    entries = []
    for key, slice_id, row, is_open, anchor in visited:
        if not is_open:
            continue
        path = paths[key]
        start, to = int(np.searchsorted(path.slices, slice_id)), path.target(slice_id, is_open, anchor, span, closes)
        for at in range(start + 1, (len(path.slices) - 1 if to is None else to) + 1):
            entries.append((int(path.slices[at]), key, anchor, int(path.before[at] - path.before[start] - row)))
    return spark.createDataFrame(entries, ENTRIES)
