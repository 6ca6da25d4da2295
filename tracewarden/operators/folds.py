"""Order-dependent state per key that no window frame can express.

Both folds run over ``ordered_slices`` (so a hot key is spread over many slices and no task ever holds a
whole key):

1. every slice reports on its first and last key - one or two rows per slice, whatever its size;
2. from those reports each slice gets the state it starts with: moving averages chain them, anchored
   groups rank the anchors of the slices (``chains``);
3. the slices run again in parallel from their entry states.

Python sees Arrow batches of a few narrow columns and keeps one key's state at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators.chains import entry_anchors
from tracewarden.operators.scale import ordered_slices


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys in a sorted batch."""
    if len(keys) == 0:
        return
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True)


def _slices_with_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None) -> DataFrame:
    # JSON tells a null part from an empty one and one part from another
    keyed = df.withColumn("fold_key", F.to_json(F.struct(*keys)))
    return ordered_slices(keyed, ["fold_key"], order, slices)


def _enter(cut: DataFrame, entries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach entry states; ``entries`` holds a row for each slice and key that is open at a border."""
    return cut.join(entries.select("slice_id", "fold_key", *columns), ["slice_id", "fold_key"], "left")


# --------------------------------------------------------------------------------------------------
# anchored groups
# --------------------------------------------------------------------------------------------------


def walk_groups(t: np.ndarray, span: int, closes: bool, anchor: int | None, seq: int):
    """Label one key's ordered times with the anchor of their group and the position inside it.

    ``closes=False``: a row more than ``span`` after the anchor starts the next group.
    ``closes=True``: the first row at least ``span`` after the anchor ends its group, itself included.
    """
    m = len(t)
    anchors = np.empty(m, np.int64)
    seqs = np.empty(m, np.int64)
    i = 0
    while i < m:
        if anchor is None:
            anchor, seq = int(t[i]), 0
        if closes:
            j = max(int(np.searchsorted(t, anchor + span, "left")), i)
            ended, e = j < m, min(j + 1, m)
        else:
            e = max(int(np.searchsorted(t, anchor + span, "right")), i)
            ended = e < m
        anchors[i:e] = anchor
        seqs[i:e] = np.arange(seq + 1, seq + 1 + e - i)
        seq += e - i
        i = e
        if ended:
            anchor, seq = None, 0
    return anchors, seqs, anchor, seq


def _label_groups(order_col: str, span: int, closes: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, seq = None, None, 0
        for b in batches:
            keys, times = b["fold_key"].to_numpy(), b[order_col].to_numpy(np.int64)
            entry, entry_seq = b["in_anchor"].to_numpy(), b["in_seq"].to_numpy()
            anchors, seqs = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for lo, hi in _runs(keys):
                if keys[lo] != key:
                    key = keys[lo]
                    anchor, seq = (None, 0) if pd.isna(entry[lo]) else (int(entry[lo]), int(entry_seq[lo]))
                anchors[lo:hi], seqs[lo:hi], anchor, seq = walk_groups(times[lo:hi], span, closes, anchor, seq)
            yield b.drop(columns=["slice_id", "fold_key", "in_anchor", "in_seq"]).assign(
                anchor_us=anchors, group_seq=seqs
            )

    return run


def anchored_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    span_us: int,
    *,
    closes: bool,
    slices: int | None = None,
) -> DataFrame:
    """Append ``anchor_us`` (first time of the row's group) and ``group_seq`` (1-based position in it).

    ``order[0]`` is the event time in microseconds, the last entry a unique tie-break.
    See ``walk_groups`` for the two grouping rules.
    """
    cut = _slices_with_key(df, keys, order, slices)
    walk = lambda times, anchor, seq: walk_groups(times, span_us, closes, anchor, seq)
    entries = entry_anchors(cut, order[0], span_us, closes=closes, walk=walk)
    schema = T.StructType([*df.schema.fields, T.StructField("anchor_us", T.LongType()), T.StructField("group_seq", T.LongType())])
    entered = _enter(cut, entries, ["in_anchor", "in_seq"])
    return entered.select(*df.columns, "slice_id", "fold_key", "in_anchor", "in_seq").mapInPandas(
        _label_groups(order[0], span_us, closes), schema
    )


# --------------------------------------------------------------------------------------------------
# exponential moving averages
# --------------------------------------------------------------------------------------------------


def ema_path(x: np.ndarray, alpha: float, state: float) -> tuple[np.ndarray, float]:
    """Averages *before* each observation, and the one after the last.

    The recurrence s' = alpha x + k s is solved block by block: within a block s after i observations is
    k^i (s + alpha (x_1 / k + ... + x_i / k^i)).  A block ends where 1 / k^i reaches 1e9, so no digits are lost.
    """
    x = np.asarray(x, np.float64)
    keep = 1.0 - alpha
    before = np.empty(len(x))
    if keep <= 0.0:
        before[:1], before[1:] = state, x[:-1]
        return before, float(x[-1]) if len(x) else state
    block = 512 if keep >= 1.0 else max(1, min(512, int(np.log(1e9) / -np.log(keep))))
    power = keep ** np.arange(1, block + 1)
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        after = power[: len(part)] * (state + alpha * np.cumsum(part / power[: len(part)]))
        before[lo] = state
        before[lo + 1 : lo + len(part)] = after[:-1]
        state = float(after[-1])
    return before, state


def ema_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seeds: Mapping[str, float],
    alpha: float,
    *,
    slices: int | None = None,
) -> DataFrame:
    """Append ``{column}_before``: the key's moving average of each column ahead of the row.

    A slice maps the state affinely, ``exit = (1 - alpha)^n * entry + b``, so slices chain by two numbers
    per column and nothing overflows however long the key is.
    """
    cols = list(seeds)
    cut = _slices_with_key(df, keys, order, slices)
    summary_ddl = "slice_id int, fold_key string, is_last boolean, decay double, " + ", ".join(
        f"b_{c} double" for c in cols
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slice_id = first_key = key = None
        decay, b = 1.0, [0.0] * len(cols)
        for batch in batches:
            ks = batch["fold_key"].to_numpy()
            for lo, hi in _runs(ks):
                if ks[lo] != key:
                    if key is None:
                        slice_id, first_key = int(batch["slice_id"].iloc[0]), ks[lo]
                    key, decay, b = ks[lo], 1.0, [0.0] * len(cols)
                decay *= (1.0 - alpha) ** (hi - lo)
                b = [ema_path(batch[c].to_numpy()[lo:hi], alpha, s)[1] for c, s in zip(cols, b, strict=True)]
        if key is None:
            return
        rows = [(slice_id, key, True, decay, *b)]
        if key != first_key:
            rows.append((slice_id, first_key, False, 1.0, *[0.0] * len(cols)))
        yield pd.DataFrame(rows, columns=["slice_id", "fold_key", "is_last", "decay", *[f"b_{c}" for c in cols]])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, state = [], None
        for r in pdf.sort_values("slice_id").to_dict("records"):
            if state is not None:
                out.append((r["slice_id"], r["fold_key"], *state))
            if r["is_last"]:
                start = state if state is not None else [seeds[c] for c in cols]
                state = [r["decay"] * s + r[f"b_{c}"] for c, s in zip(cols, start, strict=True)]
        return pd.DataFrame(out, columns=["slice_id", "fold_key", *[f"in_{c}" for c in cols]])

    entries = (
        cut.select("slice_id", "fold_key", *cols)
        .mapInPandas(summarise, summary_ddl)
        .groupBy("fold_key")
        .applyInPandas(chain, "slice_id int, fold_key string, " + ", ".join(f"in_{c} double" for c in cols))
    )

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, []
        for batch in batches:
            ks = batch["fold_key"].to_numpy()
            values = {c: batch[c].to_numpy() for c in cols}
            before = {c: np.empty(len(batch)) for c in cols}
            for lo, hi in _runs(ks):
                if ks[lo] != key:
                    key = ks[lo]
                    entry = [batch[f"in_{c}"].iloc[lo] for c in cols]
                    state = [seeds[c] if pd.isna(e) else e for c, e in zip(cols, entry, strict=True)]
                for i, c in enumerate(cols):
                    before[c][lo:hi], state[i] = ema_path(values[c][lo:hi], alpha, state[i])
            yield batch.drop(columns=["slice_id", "fold_key", *[f"in_{c}" for c in cols]]).assign(
                **{f"{c}_before": before[c] for c in cols}
            )

    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_before", T.DoubleType()) for c in cols]])
    ins = [f"in_{c}" for c in cols]
    return _enter(cut, entries, ins).select(*df.columns, "slice_id", "fold_key", *ins).mapInPandas(label, schema)
