"""Anchored groups over slices: successors, links and the doubled links against a walk along the key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_scale import frame, reference_groups
from tracewarden.operators import chains, folds


@pytest.mark.parametrize("closes", [False, True])
def test_last_anchors_are_those_of_a_walk(closes):
    rng = random.Random(1)
    for _ in range(300):
        t = np.sort([rng.randrange(0, rng.choice([5, 50, 400])) for _ in range(rng.randrange(1, 40))])
        span = rng.choice([0, 1, 7, 60])
        last = chains.last_anchors(t, span, closes)
        for start in range(len(t)):
            groups = reference_groups(t[start:].tolist(), span, closes)
            anchor, seq = groups[-1]
            closed = closes and t[-1] - anchor >= span
            assert last[start] == (len(t) if closed else len(t) - seq)


@pytest.mark.parametrize("closes", [False, True])
@pytest.mark.parametrize("span", [0, 60, 5_000])
def test_keys_that_fill_many_slices(spark, closes, span):
    """A key of dozens of slices: groups inside a slice, across some and across all of them."""
    rng = random.Random(span)
    t, rows = 0, []
    for i in range(2500):
        t += rng.choice([0, 0, 1, 3, 3, 40 if rng.random() < 0.02 else 2])
        rows.append((i, "hot" if i % 10 else f"k{i % 30}", t, 0.0))
    got = {r.id: (r.anchor_us, r.group_seq) for r in folds.anchored_groups(frame(spark, rows), ["key"], ["us", "id"], span, closes=closes, slices=19).collect()}
    for key in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == key]
        for r, want in zip(own, reference_groups([x[2] for x in own], span, closes), strict=True):
            assert got[r[0]] == want


def test_groups_that_end_with_a_slice(spark):
    """Every slice border falls right behind a closed group."""
    rows = [(i, "a", 10 * i, 0.0) for i in range(600)]
    cut = frame(spark, rows).withColumns({"fold_key": F.lit("a"), "slice_id": F.floor(F.col("id") / 60).cast("int")}).repartitionByRange(10, "slice_id").sortWithinPartitions("us")
    walk = lambda t, anchor, seq: folds.walk_groups(t, 50, True, anchor, seq)
    assert chains.entry_anchors(cut, "us", 50, closes=True, walk=walk).collect() == []  # groups of 6 rows each
    walk = lambda t, anchor, seq: folds.walk_groups(t, 60, True, anchor, seq)
    got = sorted(tuple(r) for r in chains.entry_anchors(cut, "us", 60, closes=True, walk=walk).collect())
    want = reference_groups([r[2] for r in rows], 60, True)
    assert got == [(s, "a", *want[60 * s - 1]) for s in range(1, 10) if want[60 * s - 1][1] < 7]


def test_what_meets_does_not_grow_with_a_dense_slice(spark):
    """Ten times the rows of one millisecond each: as many border rows, one a slice and key, and the same visits."""
    sent = []
    for n in (20_000, 200_000):
        df = spark.range(n).select(F.col("id"), F.lit("hot").alias("key"), (F.col("id") * 1000).alias("us"))
        cut = folds._slices_with_key(df, ["key"], ["us", "id"], 8)
        walk = lambda t, anchor, seq: folds.walk_groups(t, 1_000_000, False, anchor, seq)
        borders = cut.select("slice_id", "fold_key", "us").mapInPandas(chains._borders("us", walk), chains._BORDERS)
        entries = chains.entry_anchors(cut, "us", 1_000_000, closes=False, walk=walk)
        sent.append((borders.count(), entries.count()))
        open_rows = [len(chains.open_anchors(np.arange(n // 8) * 1000, 1_000_000, False))]
        assert max(open_rows) <= 1002  # entries lie within a span, whatever the slice holds
    assert sent[0] == sent[1] == (8, 7)
