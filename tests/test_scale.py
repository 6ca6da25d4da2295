"""The order-dependent helpers against plain Python, with one key holding a third of the rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracewarden.operators import folds, scale


def skewed(n=3000, seed=1, step=4):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 0, 1, 2, step, 9 * step if rnd.random() < 0.05 else 1])
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(60)}"
        rows.append((i, key, t, float(rnd.randrange(100))))
    return rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, us long, x double").repartition(5)


def test_prefix_sums_per_key_and_global(spark):
    rows = skewed()
    got = {r.id: (r.c, r.s) for r in scale.prefix_sums(frame(spark, rows), ["key"], ["us", "id"], {"c": F.lit(1), "s": F.col("x")}, 13).collect()}
    for group in by_key(rows).values():
        s = 0.0
        for c, r in enumerate(group, 1):
            s += r[3]
            assert got[r[0]] == (c, s)
    got = {r.id: r.c for r in scale.prefix_sums(frame(spark, rows), [], ["us", "id"], {"c": F.lit(1)}, 7).collect()}
    for c, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        assert got[r[0]] == c


def test_trailing_rows(spark):
    rows = skewed(9000)
    for keys in (["key"], []):
        got = {r.id: (r.frame_rows, r.s) for r in scale.trailing_rows(frame(spark, rows), keys, ["us", "id"], 10, {"s": F.col("x")}, 13).collect()}
        groups = by_key(rows).values() if keys else [sorted(rows, key=lambda r: (r[2], r[0]))]
        for group in groups:
            for i, r in enumerate(group):
                f = group[max(0, i - 9) : i + 1]
                assert got[r[0]] == (len(f), sum(x[3] for x in f))


def test_trailing_counts(spark):
    rows = skewed(1500)
    groups = by_key(rows)
    for inclusive in (True, False):
        for windows in ({20: None, 100: None}, {20: 6, 100: 25}):
            got = {
                (r.key, r.us, r.width_us): (r.n, r.frame_count)
                for r in scale.trailing_counts(frame(spark, rows), "key", "us", windows, inclusive=inclusive).collect()
            }
            want = {}
            for k, g in groups.items():
                times = [r[2] for r in g]
                for t in set(times):
                    for w, floor in windows.items():
                        c = sum(1 for s in times if s <= t and (s >= t - w if inclusive else s > t - w))
                        if floor is None or c > floor:
                            want[(k, t, w)] = (times.count(t), c)
            assert got == want


def test_exact_quantiles(spark):
    rows = skewed()
    probs = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    got = {(r.key, r.prob): r.quantile for r in scale.exact_quantiles(frame(spark, rows), ["key"], "x", probs).collect()}
    for k, g in by_key(rows).items():
        for p in probs:
            assert abs(got[(k, p)] - np.percentile([r[3] for r in g], p * 100)) < 1e-9
    glob = {r.prob: r.quantile for r in scale.exact_quantiles(frame(spark, rows), [], "x", probs).collect()}
    for p in probs:
        assert abs(glob[p] - np.percentile([r[3] for r in rows], p * 100)) < 1e-9


def reference_groups(times, span, closes):
    out, anchor, seq = [], None, 0
    for t in times:
        if anchor is not None and not closes and t - anchor > span:
            anchor = None
        if anchor is None:
            anchor, seq = t, 0
        seq += 1
        out.append((anchor, seq))
        if closes and t - anchor >= span:
            anchor = None
    return out


def test_anchored_groups(spark):
    for closes in (False, True):
        for seed, span, slices in ((1, 12, 17), (2, 40, 40), (3, 3, 9), (4, 400, 60)):
            rows = skewed(2500, seed)
            got = {
                r.id: (r.anchor_us, r.group_seq)
                for r in folds.anchored_groups(frame(spark, rows), ["key"], ["us", "id"], span, closes=closes, slices=slices).collect()
            }
            for g in by_key(rows).values():
                for r, w in zip(g, reference_groups([x[2] for x in g], span, closes), strict=True):
                    assert got[r[0]] == w, (closes, seed)


def test_anchored_groups_on_exact_edges(spark):
    rows = [(i, "a", t, 0.0) for i, t in enumerate([0, 300, 301, 601, 602, 603, 1200])]
    got = [(r.us, r.anchor_us, r.group_seq) for r in folds.anchored_groups(frame(spark, rows), ["key"], ["us", "id"], 300, closes=False).orderBy("us").collect()]
    assert [g[1] for g in got] == [0, 0, 301, 301, 602, 602, 1200]
    got = [r.anchor_us for r in folds.anchored_groups(frame(spark, rows), ["key"], ["us", "id"], 300, closes=True).orderBy("us").collect()]
    assert got == [0, 0, 301, 301, 602, 602, 602]


def test_ema_before(spark):
    rows = skewed(2500)
    got = {r.id: r.x_before for r in folds.ema_before(frame(spark, rows), ["key"], ["us", "id"], {"x": 2.1}, 0.1, slices=23).collect()}
    for g in by_key(rows).values():
        s = 2.1
        for r in g:
            assert abs(got[r[0]] - s) < 1e-9
            s = 0.1 * r[3] + 0.9 * s


def test_empty_inputs(spark):
    empty = frame(spark, [])
    assert scale.prefix_sums(empty, ["key"], ["us", "id"], {"c": F.lit(1)}).count() == 0
    assert scale.trailing_counts(empty, "key", "us", {20: 1}).count() == 0
    assert scale.exact_quantiles(empty, [], "x", [0.5]).count() == 0
    assert folds.anchored_groups(empty, ["key"], ["us", "id"], 5, closes=True).count() == 0
    assert folds.ema_before(empty, ["key"], ["us", "id"], {"x": 1.0}, 0.1).count() == 0
