"""Hand-made frames: empty input, single rows, ties, nulls, zero variance, single class, exact edges."""

import math

from pyspark.sql import functions as F

from tracewarden.operators import baseline, cleanup, detectors, drift, evaluation, features, fusion, lookups, reports
from tracewarden.sources import files

MIN = 60_000_000
LOG = "event_id long, us long, ts timestamp, remote_addr string, request_method string, request_uri string, status int, body_bytes_sent long, request_time double, http_user_agent string, http_referer string"


def log(spark, rows):
    """Rows are (minute, address, status, uri)."""
    full = [(i, int(m * MIN), None, ip, "GET", uri, st, 1024, 0.1, "Mozilla Chrome/120.0", "-") for i, (m, ip, st, uri) in enumerate(rows)]
    return spark.createDataFrame(full, LOG)


def test_empty_inputs(spark):
    empty = log(spark, [])
    assert detectors.login_brute_force(empty).count() == 0
    assert detectors.rate_limit(empty).count() == 0
    assert detectors.error_rate_spike(empty).count() == 0
    assert detectors.multi_window(empty).count() == 0
    assert features.behaviour_features(empty, MIN).count() == 0
    assert cleanup.shipped_log(empty).count() == 0
    row = baseline.status_distribution(empty).collect()[0]
    assert row.error_rate == 0.0 and row.threshold_error_rate == 0.0
    assert baseline.user_agents(empty).collect()[0].diversity_ratio == 0.0


def test_two_events_in_one_minute(spark):
    flows = spark.createDataFrame(
        [("10.0.0.1", 0, 100, 10, 80, "a", 0, 0, 0, 1.0, 0), ("10.0.0.1", 30_000_000, 200, 20, 443, "b", 1, 1, 0, 2.0, 1)],
        "src_ip string, us long, bytes_in long, bytes_out long, dst_port int, domain string, is_nxdomain int, failed_login int, fortiguard_hit int, cvss_score double, is_vuln int",
    )
    r = features.flow_windows(flows, MIN).collect()
    assert len(r) == 1 and r[0].bytes_in_sum == 300 and r[0].dst_port_nunique == 2 and abs(r[0].domain_entropy - 1.0) < 1e-6
    assert r[0].is_nxdomain_mean == 0.5 and r[0].cvss_score_max == 2.0


def test_gap_day_is_filled_with_zero_sums_and_null_means(spark):
    w = spark.createDataFrame([("a", 1, 5, 0.5), ("a", 4, 7, 0.1), ("b", 2, 1, 1.0)], "src_ip string, bucket long, total long, mean double")
    filled = {(r.src_ip, r.bucket): (r.total, r["mean"]) for r in features.fill_gaps(w, "src_ip", ["total"], ["mean"]).collect()}
    assert filled == {("a", 1): (5, 0.5), ("a", 2): (0, None), ("a", 3): (0, None), ("a", 4): (7, 0.1), ("b", 2): (1, 1.0)}
    deltas = {(r.src_ip, r.bucket): r.d for r in features.window_deltas(features.fill_gaps(w, "src_ip", ["total"]), "src_ip", {"total": "d"}).collect()}
    assert deltas == {("a", 1): 0, ("a", 2): -5, ("a", 3): 0, ("a", 4): 7, ("b", 2): 0}


def test_single_event_features(spark):
    r = features.behaviour_features(log(spark, [(0, "a", 200, "/x?y=1")]), MIN).collect()[0]
    assert (r.f1_request_frequency, r.f2_endpoint_entropy, r.f5_timing_variance, r.f9_session_length) == (1.0, 0.0, 0.0, 0.0)
    assert r.f10_payload_size_zscore == 0.0 and r.f7_http_method_gini == 0.0


def test_zero_deviation_baseline_gives_zero(spark):
    r = features.behaviour_features(log(spark, [(0, "a", 200, "/x")]), MIN, body_std=0.0).collect()[0]
    assert r.f10_payload_size_zscore == 0.0


def test_rate_limit_counts_peers_and_left_edge(spark):
    rows = [(0, "a", 200, "/")] * 3 + [(1, "a", 200, "/")]  # the three are exactly one minute old
    fired = {(r.event_id, r.window_requests) for r in detectors.rate_limit(log(spark, rows), 3.0).collect()}
    assert fired == {(3, 4)}
    fired = {r.event_id for r in detectors.rate_limit(log(spark, rows), 2.0).collect()}
    assert fired == {0, 1, 2, 3}
    strict = {r.event_id: r for r in detectors.flood_or_classify(log(spark, rows), 2.0).collect()}
    assert set(strict) == {0, 1, 2} and strict[0].attack_type == "DoS Flood" and strict[0].severity == "HIGH"


def test_brute_force_needs_auth_failures(spark):
    rows = [(i / 100, "a", 401, "/login") for i in range(12)] + [(i / 100, "b", 401, "/other") for i in range(12)] + [(i / 100, "c", 200, "/login") for i in range(12)]
    found = detectors.login_brute_force(log(spark, rows)).collect()
    assert {(r.remote_addr, r.failures, r.severity) for r in found} == {("a", 11, "critical"), ("a", 12, "critical")}


def test_error_spike_needs_ten_events(spark):
    rows = [(i, "a", 500, "/") for i in range(12)]
    found = detectors.error_rate_spike(log(spark, rows)).collect()
    assert sorted(r.window_size for r in found) == [10, 11, 12] and all(r.severity == "critical" and r.confidence == 1.0 for r in found)


def test_confirmation_waits_for_a_full_window(spark):
    rows = [(i, i * MIN, "e", i < 6) for i in range(14)] + [(99, 0, "once", True)]
    df = spark.createDataFrame(rows, "event_id long, us long, entity_id string, flag boolean")
    got = {r.event_id: r.escalated for r in detectors.confirm(df, F.col("flag")).collect()}
    assert [i for i in range(14) if got[i]] == [9, 10, 11] and not got[99]


def test_unparsable_times_and_numbers(spark):
    raw = spark.createDataFrame(
        [("2024-01-01T00:00:00Z", "200", "1", "0.1", None, None, None), ("nonsense", "200", "1", "0.1", "a", "/", "x"), (None, "200", "1", "0.1", "a", "/", "x")],
        "timestamp string, status string, body_bytes_sent string, request_time string, remote_addr string, request_uri string, http_user_agent string",
    )
    rows = cleanup.prepared_log(raw).collect()
    assert len(rows) == 1 and (rows[0].remote_addr, rows[0].request_uri, rows[0].http_user_agent) == ("unknown", "/", "-")
    bad = spark.createDataFrame([("/health", "200", "1", "1"), ("/x", "oops", "", "7")], "request_uri string, status string, body_bytes_sent string, request_length string")
    r = cleanup.shipped_log(bad).collect()
    assert len(r) == 1 and r[0].status is None and r[0].body_bytes_sent is None and r[0].request_length == 7 and r[0].status_class is None


def test_status_upsert_and_blocklist(spark):
    cur = spark.createDataFrame([("a", "ACTIVE", 1), ("b", "ACTIVE", 1)], "alert_id string, status string, updated_us long")
    new = spark.createDataFrame([("a", "RESOLVED", 2), ("c", "BLOCKED", 1)], "alert_id string, status string, updated_us long")
    assert {(r.alert_id, r.status) for r in lookups.upsert_status(cur, new).collect()} == {("a", "RESOLVED"), ("b", "ACTIVE"), ("c", "BLOCKED")}
    have = spark.createDataFrame([("1.1.1.1", "old")], "ip string, reason string")
    add = spark.createDataFrame([("1.1.1.1", "dup"), ("2.2.2.2", "x"), ("2.2.2.2", "y")], "ip string, reason string")
    assert {(r.ip, r.reason) for r in lookups.add_absent(have, add, "ip").collect()} == {("1.1.1.1", "old"), ("2.2.2.2", "x")}


JUDGED = "event_id long, us long, y int, s double"


def test_single_class_and_never_detected(spark):
    one = spark.createDataFrame([(i, i * 1_000_000, 1, 0.1) for i in range(5)], JUDGED)
    r = evaluation.report(one, "y", "s", "event_id").collect()[0]
    assert r.roc_auc == 0.0 and r.asr == 1.0 and r.precision_at_1_pct == 1.0
    assert math.isinf(evaluation.detection_delay(one, "y", "s", "us").collect()[0].delay_seconds)
    none = one.withColumn("y", F.lit(0))
    assert evaluation.detection_delay(none, "y", "s", "us").collect()[0].delay_seconds == 0.0
    assert evaluation.attack_success_rate(none, "y", "s").collect()[0].asr == 0.0


def test_perfect_and_inverted_ranking(spark):
    rows = [(i, i, int(i >= 6), i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, JUDGED)
    assert evaluation.roc_summary(evaluation.curve_points(df, "y", "s"), "s").collect()[0].auc == 1.0
    pr = evaluation.pr_summary(evaluation.curve_points(df, "y", "s"), "s").collect()[0]
    assert abs(pr.pr_auc - 1.0) < 1e-9 and pr.best_threshold == 0.6
    inverted = evaluation.roc_summary(evaluation.curve_points(df.withColumn("s", -F.col("s")), "y", "s"), "s").collect()[0]
    assert inverted.auc == 0.0 and inverted.optimal_threshold is None


def test_mcnemar_identical(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 0, 0)], "y int, a int, b int")
    r = evaluation.mcnemar(evaluation.paired_counts(df, "y", {"ab": ("a", "b")})).collect()[0]
    assert r.p_value == 1.0 and r.interpretation == "Same verdict everywhere"


def test_drift_of_constant_and_shifted_features(spark):
    old = spark.createDataFrame([("const", 1.0)] * 50 + [("move", float(i)) for i in range(50)], "feature string, value double")
    new = spark.createDataFrame([("const", 1.0)] * 50 + [("move", float(i + 25)) for i in range(50)], "feature string, value double")
    r = {x.feature: x for x in drift.drift_report(old, new).collect()}
    assert r["const"].psi == 0.0 and r["const"].status == "STABLE" and r["const"].ks_stat == 0.0
    assert r["move"].status == "DRIFT_DETECTED" and r["move"].ks_stat == 0.5
    assert drift.retrain_decision(drift.drift_report(old, new)).collect()[0].should_retrain


def test_min_max_and_degraded(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert [r.o for r in fusion.min_max(df, "a", "o").orderBy("a").collect()] == [0.0, 0.5, 1.0]
    assert [r.o for r in fusion.min_max(df, "b", "o").collect()] == [3.0, 3.0, 3.0]
    modes = spark.createDataFrame([(0.9, 0.5, 0.1), (0.9, 0.5, None), (0.9, None, None), (None, 0.5, 0.1)], "r double, m double, c double")
    got = [x.d.mode for x in modes.select(fusion.degraded(F.col("r"), F.col("m"), F.col("c")).alias("d")).collect()]
    assert got == ["full", "degraded", "minimal", "passthrough"]


def test_sustained_condition(spark):
    s = spark.createDataFrame([(i, i in (2, 3, 4, 6, 7)) for i in range(9)], "bucket long, hot boolean")
    got = {r.bucket for r in reports.sustained(s, F.col("hot"), 2).collect() if r.firing}
    assert got == {4}


def test_sessions_split_only_beyond_the_gap(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 9, 10, 20, 31, 32)], "k string, us long")
    got = sorted((r.start_us, r.end_us, r.requests) for r in features.sessions(df, "k", "us", 10, {}).collect())
    assert got == [(0, 20, 4), (31, 32, 2)]


def test_corrupt_lines_are_kept(spark, tmp_path):
    spark.createDataFrame([('{"remote_addr": "1.2.3.4", "status": "200"}',), ("{broken",)], "value string").write.text(str(tmp_path / "l"))
    rows = files.read_access_log(spark, str(tmp_path / "l")).select("remote_addr", "_corrupt_record").collect()
    assert {(r.remote_addr, r._corrupt_record) for r in rows} == {("1.2.3.4", None), (None, "{broken")}


def test_alert_batch_replay_is_idempotent(spark, tmp_path):
    df = files.with_alert_key(spark.createDataFrame([(1, "r"), (1, "r"), (2, "r")], "event_id long, rule string"), "event_id", "rule")
    for _ in range(2):
        files.write_alert_batch(df, str(tmp_path), 3)
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_thresholds_default_when_absent(spark):
    r = files.load_thresholds(spark, None).collect()[0]
    assert r.rate_limit_req_per_min == 30.0 and r.error_rate_threshold == 0.30


def test_hot_source_in_distributions_and_sessions(spark):
    """One address holds half of the rows; results against plain Python."""
    import random
    from collections import Counter

    rnd = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"c{i % 40}", f"/p{rnd.randrange(900)}?x={i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "us long, k string, uri string").repartition(6)
    counts = features.value_counts(df, ["k"], F.substring_index("uri", "?", 1))
    got = {r.k: r for r in features.distribution(counts, ["k"], 1e-12, "v").collect()}
    for k in ("hot", "c0", "c14"):
        c = Counter(u.split("?")[0] for _, q, u in rows if q == k)
        total = sum(c.values())
        assert got[k].v_distinct == len(c)
        assert abs(got[k].v_entropy + sum(n / total * math.log2(n / total + 1e-12) for n in c.values())) < 1e-9
        assert abs(got[k].v_gini - (1 - sum((n / total) ** 2 for n in c.values()))) < 1e-9
    stretched = df.withColumn("us", F.col("us") * F.when(F.col("us") > 2000, 1000).otherwise(1))
    want = {}
    for us, k, _ in rows:
        us = us * 1000 if us > 2000 else us
        runs = want.setdefault(k, [])
        if runs and us - runs[-1][1] <= 500:
            runs[-1] = (runs[-1][0], us, runs[-1][2] + 1)
        else:
            runs.append((us, us, 1))
    found = {}
    for r in features.sessions(stretched, "k", "us", 500, {}).collect():
        found.setdefault(r.k, []).append((r.start_us, r.end_us, r.requests))
    assert {k: sorted(v) for k, v in found.items()} == want


def test_profile_lookup():
    from tracewarden.functions.calibration import profile_columns

    assert profile_columns("Balanced")["alert_at"] == 0.45
