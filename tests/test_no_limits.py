"""Values of any size, keys that are null, and times that are unknown."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import baseline, drift, features, folds, lookups, scale


@pytest.mark.parametrize("unit", [1.0, 1e-13, 1e13])
def test_psi_has_no_scale(spark, unit):
    frame = lambda factor: spark.createDataFrame([("f", factor * i * unit) for i in range(1000)], "feature string, value double")
    assert drift.psi(frame(1.0), frame(0.3)).first().psi == pytest.approx(8.2045, abs=1e-3)


@pytest.mark.parametrize("values", [range(560, 640), [0, 0, 1, 3], [0], [5, 5, 5, 4000], range(100_000, 100_050)])
def test_one_poisson_law_for_any_mean(spark, values):
    values = sorted(values)
    counts = spark.createDataFrame(list(Counter(values).items()), "n long, weight long")
    lam, n = sum(values) / len(values), len(values)
    low = max(0, int(lam - 60 * math.sqrt(lam) - 100)) if lam else 0
    law = lambda x: math.fsum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(low, x + 1)) if lam else 1.0
    want = max(max(sum(v <= x for v in values) / n - law(x), law(x) - sum(v < x for v in values) / n) for x in set(values))
    assert baseline.poisson_distance(counts).first().ks_stat == pytest.approx(want, abs=1e-7)


def test_null_keys_keep_their_history(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "a") for k in range(40)], "k long, key string")
    rows = scale.prefix_sums(df, ["key"], ["k"], {"seen": F.lit(1)}, slices=5).collect()
    assert all(r.seen == r.k // 2 + 1 for r in rows)
    last = scale.trailing_rows(df, ["key"], ["k"], 3, {"s": F.col("k")}, slices=5).collect()
    assert all(r.s == sum(x for x in (r.k, r.k - 2, r.k - 4) if x >= 0) for r in last)


def test_composite_keys_with_nulls_stay_apart(spark):
    rows = [("x", None, 1), (None, "x", 2), ("x", "", 3), ("", "x", 4), ("x\u001fy", None, 5), ("x", "y", 6)]
    df = spark.createDataFrame(rows, "a string, b string, us long")
    out = folds.anchored_groups(df, ["a", "b"], ["us"], 1_000, closes=False)
    assert all(r.group_seq == 1 for r in out.collect())


def test_unknown_times_do_not_stretch_the_time_line(spark):
    w = spark.createDataFrame([("a", 0, 5), ("a", 2_800_000, 1), ("a", 2_800_002, 2), ("b", 0, 7)], "src_ip string, bucket long, n long")
    got = {(r.src_ip, r.bucket): r.n for r in features.fill_gaps(w, "src_ip", ["n"]).collect()}
    assert got == {("a", 0): 5, ("a", 2_800_000): 1, ("a", 2_800_001): 0, ("a", 2_800_002): 2, ("b", 0): 7}


def test_thresholds_of_vendors(spark):
    reports = spark.createDataFrame([("1", "p", 60, 0, []), ("2", "q", 60, 0, []), ("3", "p", 76, 0, [])], "ip string, source string, raw_score int, confidence int, tags array<string>")
    got = {r.ip: r.malicious for r in lookups.normalised_intel(reports, {"p": 75}).collect()}
    assert got == {"1": False, "2": True, "3": True}
