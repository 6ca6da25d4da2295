"""What the plans and the code must never contain."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from tracewarden.operators import detectors, evaluation
from tracewarden.sources.tables import DAY, Tables

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent
# jobs of many steps, of which only the last would be looked at
LONG = ("win19_idle_eviction", "ml06_grid_search", "ml07_cross_validation", "ml08_learning_curve", "ml09_augmented_training", "ml11_permutation_importance")
CHEAP = [n for n in entry.queries() if n[:3] in ("prj", "sig", "agg", "fus", "jn0", "jn1", "evl", "win", "gr0", "sc0", "ml0") and n not in LONG]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_joins_and_no_global_frames(spark, no_auto_broadcast, name):
    p = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "BatchEvalPython" not in p
    lines = p.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and any("Window" in x for x in lines[max(0, i - 2) : i]):
            # only summaries may meet in one task: a row per slice, or a row per severity level
            assert "slice_id" in lines[i - 1] + lines[i - 2] or "severity" in "".join(lines[i : i + 4]), line


def test_global_order_frames_sort_slices_only(spark, no_auto_broadcast):
    log = Tables(spark, FOLDER).log
    for df in (detectors.error_rate_spike(log), detectors.dynamic_threshold(detectors.event_estimates(log))):
        windows = [x for x in plan(df).split("\n") if re.search(r"Window \[", x)]
        assert windows and all("slice_id" in w or "_block" in w for w in windows)


def test_curve_is_built_from_value_counts(spark, no_auto_broadcast):
    t = Tables(spark, FOLDER)
    p = plan(evaluation.roc_summary(evaluation.curve_points(t.judged, "y_true", "score"), "score"))
    assert "FileScan" not in p  # the value counts were cut off into slices; the curve never rescans events


def test_scan_is_pruned_and_filtered(spark):
    df = Tables(spark, FOLDER).read("events").filter("event_type = 'error'").groupBy("user_id").count()
    p = plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p and "ReadSchema: struct<user_id:bigint,event_type:string>" in p


def test_rules_window_is_a_day():
    assert DAY == 86_400_000_000


def test_forbidden_calls_are_absent():
    banned = ("localCheckpoint", ".crossJoin(", ".rdd", "coalesce(1)", "repartition(1)", "toLocalIterator")
    for f in ROOT.glob("tracewarden/**/*.py"):
        text = f.read_text()
        assert not [b for b in banned if b in text], f
