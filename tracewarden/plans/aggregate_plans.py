"""Windowed features, baselines, counters and reports."""

from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.operators import baseline, features, reports
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import DAY, suspicion, text

HOUR = 3_600_000_000


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


FLOW_COLUMNS = (
    "src_ip, bucket, bytes_in_sum, bytes_out_sum, conn_count, dst_port_nunique, domain_nunique, round(domain_entropy, 6) AS domain_entropy,"
    " round(is_nxdomain_mean, 6) AS is_nxdomain_mean, failed_login_sum, fortiguard_hit_sum, cvss_score_max, is_vuln_sum"
)


@query("agg01_entity_windows", f"SELECT {FLOW_COLUMNS} FROM flow_days", ("flow_days",))
def _(t):
    df = features.flow_windows(t.flows, DAY)
    return df.withColumns({"domain_entropy": F.round("domain_entropy", 6), "is_nxdomain_mean": F.round("is_nxdomain_mean", 6)})


@query(
    "agg02_gap_filled_windows",
    """SELECT g.src_ip, g.bucket, coalesce(bytes_in_sum, 0) AS bytes_in_sum, coalesce(dst_port_nunique, 0) AS dst_port_nunique,
         coalesce(domain_nunique, 0) AS domain_nunique, coalesce(round(domain_entropy, 6), 0) AS domain_entropy, round(is_nxdomain_mean, 6) AS is_nxdomain_mean, cvss_score_max
       FROM (SELECT src_ip, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM flow_days GROUP BY 1) g LEFT JOIN flow_days f
       ON f.src_ip = g.src_ip AND f.bucket = g.bucket""",
    ("flow_days",),
)
def _(t):
    w = features.flow_windows(t.flows, DAY)
    zeros = ["bytes_in_sum", "dst_port_nunique", "domain_nunique", "domain_entropy"]
    df = features.fill_gaps(w, "src_ip", zeros, ["is_nxdomain_mean", "cvss_score_max"])
    return df.withColumns({"domain_entropy": F.round("domain_entropy", 6), "is_nxdomain_mean": F.round("is_nxdomain_mean", 6)})


@query(
    "agg03_window_deltas",
    """SELECT src_ip, bucket, coalesce(b - lag(b) OVER w, 0) AS delta_bytes_in, coalesce(p - lag(p) OVER w, 0) AS delta_port_nunique,
         coalesce(c - lag(c) OVER w, 0) AS delta_conn_count
       FROM (SELECT g.src_ip, g.bucket, coalesce(bytes_in_sum, 0) AS b, coalesce(dst_port_nunique, 0) AS p, coalesce(conn_count, 0) AS c
         FROM (SELECT src_ip, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM flow_days GROUP BY 1) g LEFT JOIN flow_days f
         ON f.src_ip = g.src_ip AND f.bucket = g.bucket) WINDOW w AS (PARTITION BY src_ip ORDER BY bucket)""",
    ("flow_days",),
)
def _(t):
    filled = features.fill_gaps(features.flow_windows(t.flows, DAY), "src_ip", ["bytes_in_sum", "dst_port_nunique", "conn_count"])
    deltas = {"bytes_in_sum": "delta_bytes_in", "dst_port_nunique": "delta_port_nunique", "conn_count": "delta_conn_count"}
    return features.window_deltas(filled, "src_ip", deltas).select("src_ip", "bucket", *deltas.values())


@query(
    "agg04_value_entropy",
    """SELECT source, lang, n_values, round(h, 6) AS entropy FROM (SELECT source, lang, count(*) AS n_values, -sum(p * log2(p + 1e-9)) AS h FROM (
         SELECT source, lang, n / sum(n) OVER (PARTITION BY source, lang) AS p FROM (
           SELECT source, lang, n_chars, count(*) AS n FROM documents GROUP BY 1, 2, 3)) GROUP BY 1, 2)""",
)
def _(t):
    keys = ["source", "lang"]
    d = features.distribution(features.value_counts(t.read("documents"), keys, F.col("n_chars")), keys, 1e-9, "v")
    return d.select(*keys, F.col("v_distinct").alias("n_values"), F.round("v_entropy", 6).alias("entropy"))


@query(
    "agg05_address_window_groups",
    f"SELECT remote_addr, CASE WHEN k % 23 = 1 THEN 0 ELSE us // {DAY} END AS bucket, count(*) AS n FROM log GROUP BY 1, 2",
    ("log",),
)
def _(t):
    us = F.when(F.col("k") % 23 != 1, F.col("us"))  # unparsable times
    return t.log.groupBy("remote_addr", features.bucket_of(us, DAY).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_FEATURE_QUERIES = {
    "agg06_request_frequency": "f1_request_frequency",
    "agg07_endpoint_entropy": "f2_endpoint_entropy",
    "agg08_failed_ratio": "f3_failed_request_ratio",
    "agg09_uri_char_entropy": "f4_uri_char_entropy",
    "agg10_timing_variance": "f5_timing_variance",
    "agg11_unique_endpoints": "f6_unique_endpoints_per_min",
    "agg12_method_gini": "f7_http_method_gini",
    "agg13_agent_suspicion": "f8_ua_suspicion_score",
    "agg14_session_length": "f9_session_length",
    "agg15_payload_zscore": "f10_payload_size_zscore",
}


def _feature_query(name, column):
    @query(name, f"SELECT ip, bucket, {column} FROM features", ("features",))
    def _(t):
        return features.behaviour_features(t.log, DAY).select("ip", "bucket", *r6(column))


for _name, _column in _FEATURE_QUERIES.items():
    _feature_query(_name, _column)


@query("agg16_ten_features", "SELECT ip, bucket, event_count, " + ", ".join(features.FEATURES) + " FROM features", ("features",))
def _(t):
    return features.behaviour_features(t.log, DAY).select("ip", "bucket", "event_count", *r6(*features.FEATURES))


@query(
    "agg17_frequency_profile",
    """WITH c AS (SELECT n, count(*) AS w, sum(count(*)) OVER (ORDER BY n) AS cum FROM daily GROUP BY n),
       s AS (SELECT CAST(sum(w) AS DOUBLE) AS total, sum(n * w) / sum(w) AS lam FROM c),
       p AS (SELECT i, exp(-lam + i * ln(lam) - lgamma(i + 1)) AS pmf FROM s, range(0, 100) r(i)),
       k AS (SELECT max(greatest(cum / total - f, f - (cum - w) / total)) AS ks FROM (
         SELECT c.*, total, (SELECT sum(pmf) FROM p WHERE i <= c.n) AS f FROM c, s))
       SELECT f.n AS observations, round(mean, 6) AS mean, round(p50, 6) AS median, round(std, 6) AS std, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis,
         round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95, round(p99, 6) AS p99, round(p999, 6) AS p999,
         round(p99 + 3 * std, 6) AS threshold, round(p99 + 2 * std, 6) AS threshold_conservative, round(p95 + 3 * std, 6) AS threshold_aggressive,
         round(ks, 6) AS ks_stat FROM freq f, k""",
    ("freq",),
)
def _(t):
    df = baseline.request_frequency(baseline.requests_per_bucket(t.log, DAY))
    return df.select("observations", *r6("mean", "median", "std", "skewness", "kurtosis", "p50", "p90", "p95", "p99", "p999", "threshold", "threshold_conservative", "threshold_aggressive", "ks_stat"))


@query(
    "agg18_endpoint_distribution",
    """WITH c AS (SELECT request_uri, count(*) AS n FROM log GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS u FROM c),
       h AS (SELECT -sum(n / total * log2(n / total)) AS h FROM c, t),
       b AS (SELECT string_agg(request_uri || '=' || n, ',' ORDER BY n DESC, request_uri) AS top FROM (SELECT * FROM c ORDER BY n DESC, request_uri LIMIT 10))
       SELECT u AS unique_uris, round(h, 6) AS entropy_bits, round(log2(u), 6) AS entropy_max, round(h / log2(u), 6) AS entropy_norm,
         round(2 * h / log2(u), 6) AS scan_threshold, top AS top_endpoints FROM t, h, b""",
    ("log",),
)
def _(t):
    df = baseline.endpoint_distribution(t.log)
    listed = F.array_join(F.transform(F.map_entries("top_endpoints"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.select("unique_uris", *r6("entropy_bits", "entropy_max", "entropy_norm", "scan_threshold"), listed.alias("top_endpoints"))


@query(
    "agg19_status_distribution",
    """SELECT s.total AS total_requests, round(error_rate, 6) AS error_rate, round(rate_4xx, 6) AS rate_4xx, round(rate_5xx, 6) AS rate_5xx,
         round(6 * error_rate, 6) AS threshold_error_rate, round(6 * rate_4xx, 6) AS threshold_4xx_rate, round(6 * rate_5xx, 6) AS threshold_5xx_rate,
         (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM log GROUP BY 1)) AS status_codes FROM status_mix s""",
    ("status_mix",),
)
def _(t):
    df = baseline.status_distribution(t.log)
    listed = F.array_join(F.transform(F.map_entries("status_codes"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")
    names = ["error_rate", "rate_4xx", "rate_5xx", "threshold_error_rate", "threshold_4xx_rate", "threshold_5xx_rate"]
    return df.select("total_requests", *r6(*names), listed.alias("status_codes"))


@query(
    "agg19_status_table",
    """SELECT status, count(*) AS n, CASE WHEN status < 300 THEN 'Success' WHEN status < 400 THEN 'Redirect' WHEN status < 500 THEN 'Client Error'
         ELSE 'Server Error' END AS category FROM log GROUP BY 1""",
    ("log",),
)
def _(t):
    return baseline.status_table(t.log)


@query(
    "agg20_agent_diversity",
    f"""SELECT u AS unique_user_agents, round(u / total, 6) AS diversity_ratio, s AS suspicious_ua_count, round(s / total, 6) AS suspicious_ua_rate,
         round(0.1 * u / total, 6) AS detection_threshold_diversity FROM (SELECT count(DISTINCT http_user_agent) AS u, count(*) AS total,
         count(*) FILTER (WHERE regexp_matches(lower(http_user_agent), {text(S.BASELINE_SUSPICIOUS_AGENTS)})) AS s FROM log)""",
    ("log",),
)
def _(t):
    return baseline.user_agents(t.log).select("unique_user_agents", "suspicious_ua_count", *r6("diversity_ratio", "suspicious_ua_rate", "detection_threshold_diversity"))


@query(
    "agg20_top_agents",
    "SELECT http_user_agent, count(*) AS n FROM log GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5",
    ("log",),
)
def _(t):
    return reports.top_values(t.log, "http_user_agent", 5)


@query(
    "agg21_baseline_profile",
    """SELECT (SELECT count(*) FROM log) AS total_requests, (SELECT count(DISTINCT remote_addr) FROM log) AS unique_ips,
         (SELECT min(us) FROM log) AS start_us, (SELECT max(us) FROM log) AS end_us, round(p99 + 3 * std, 4) AS rate_limit_req_per_min,
         round(p99 + 2 * std, 4) AS rate_limit_conservative, round(p95 + 3 * std, 4) AS rate_limit_aggressive, round(6 * error_rate, 6) AS error_rate_threshold,
         round(6 * rate_4xx, 6) AS rate_4xx_threshold, round(6 * rate_5xx, 6) AS rate_5xx_threshold,
         printf('P99(%.4f) + 3σ(%.4f)', p99, 3 * std) AS rate_limit_rationale, printf('6x baseline error rate (%.4f)', error_rate) AS error_rate_rationale
       FROM freq, status_mix""",
    ("freq", "status_mix"),
)
def _(t):
    p = baseline.profile(t.log, DAY)
    return p.select(
        "metadata.total_requests", "metadata.unique_ips", F.unix_micros("metadata.start").alias("start_us"), F.unix_micros("metadata.end").alias("end_us"),
        *[f"detection_thresholds.{c}" for c in ("rate_limit_req_per_min", "rate_limit_conservative", "rate_limit_aggressive", "error_rate_threshold", "rate_4xx_threshold", "rate_5xx_threshold", "rate_limit_rationale", "error_rate_rationale")],
    )


@query("agg22_requests_per_window", f"SELECT us // {HOUR} AS bucket, count(*) AS n FROM log GROUP BY 1", ("log",))
def _(t):
    return t.log.groupBy(features.bucket_of(F.col("us"), HOUR).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg22_frequency_histogram",
    """SELECT least(CAST(floor((n - lo) * 30 / greatest(hi - lo, 1)) AS BIGINT), 29) AS bin, count(*) AS n
       FROM (SELECT n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM daily) GROUP BY 1""",
    ("daily",),
)
def _(t):
    return reports_histogram(t)


def reports_histogram(t):
    return baseline.frequency_histogram(baseline.requests_per_bucket(t.log, DAY))


@query("agg22_top_endpoints", "SELECT request_uri, count(*) AS n FROM log GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8", ("log",))
def _(t):
    return reports.top_values(t.log, "request_uri", 8)


@query(
    "agg23_severity_counts",
    """SELECT severity, CAST(sum(n) AS BIGINT) AS n, (SELECT count(*) FROM alerts) AS total FROM (
         SELECT severity, count(*) AS n FROM alerts GROUP BY 1 UNION ALL SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']), 0) GROUP BY 1""",
    ("alerts",),
)
def _(t):
    return reports.severity_counts(t.alerts)


@query(
    "agg24_severity_tiles",
    "SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity IN ('HIGH', 'MEDIUM')) AS warning, count(*) AS total FROM alerts",
    ("alerts",),
)
def _(t):
    return reports.severity_tiles(t.alerts)


@query("agg25_attack_types", "SELECT attack_type, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", ("alerts",))
def _(t):
    return reports.top_values(t.alerts, "attack_type", 10)


@query("agg26_top_sources", "SELECT source_ip, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", ("alerts",))
def _(t):
    return reports.top_values(t.alerts, "source_ip", 10)


@query(
    "agg27_traffic_histogram",
    """WITH m AS (SELECT max(us // 60000000) AS hi FROM log), g AS (SELECT unnest(range(hi - 29, hi + 1)) AS bucket FROM m),
       c AS (SELECT us // 60000000 AS bucket, sum(body_bytes_sent) AS b, count(*) AS n FROM log GROUP BY 1)
       SELECT bucket, CAST(coalesce(b, 0) AS BIGINT) AS inbound, CAST(floor(coalesce(b, 0) * 0.4::DOUBLE) AS BIGINT) AS outbound,
         coalesce(n, 0) // 10 AS threats FROM g LEFT JOIN c USING (bucket)""",
    ("log",),
)
def _(t):
    return reports.traffic_histogram(t.log, 60_000_000, 30)


@query("agg28_active_sources", f"SELECT count(DISTINCT source_ip) AS active_sources FROM alerts WHERE us > (SELECT max(us) FROM alerts) - 5 * {DAY}", ("alerts",))
def _(t):
    return reports.active_sources(t.alerts, 5 * DAY)


@query("agg29_alert_counters", "SELECT attack_type, rule, severity, count(*) AS n FROM alerts GROUP BY ALL", ("alerts",))
def _(t):
    return reports.counters(t.alerts, ["attack_type", "rule", "severity"])


_BOUNDS = ", ".join(f"('{b}', {b}::DOUBLE)" for b in reports.RULE_LATENCY_BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)"
_MODEL_BOUNDS = ", ".join(f"('{b}', {b}::DOUBLE)" for b in reports.MODEL_LATENCY_BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)"


@query(
    "agg30_latency_histogram",
    f"""SELECT event_type, le, CAST(count(*) FILTER (WHERE request_time <= bound) AS BIGINT) AS n
        FROM log, (VALUES {_BOUNDS}) v(le, bound) GROUP BY 1, 2""",
    ("log",),
)
def _(t):
    return reports.cumulative_histogram(t.log, "request_time", reports.RULE_LATENCY_BOUNDS, ["event_type"])


@query(
    "agg30_model_latency_histogram",
    f"""SELECT event_type, le, CAST(count(*) FILTER (WHERE request_time <= bound) AS BIGINT) AS n
        FROM log, (VALUES {_MODEL_BOUNDS}) v(le, bound) GROUP BY 1, 2""",
    ("log",),
)
def _(t):
    return reports.cumulative_histogram(t.log, "request_time", reports.MODEL_LATENCY_BOUNDS, ["event_type"])


@query(
    "agg31_monitoring_conditions",
    f"""WITH s AS (SELECT us // {HOUR} AS bucket, avg(CASE WHEN status >= 500 THEN 1.0 ELSE 0.0 END) AS r5,
          avg(CASE WHEN is_attack THEN 0.0 WHEN {suspicion('http_user_agent')} >= 1.0 THEN 1.0 ELSE 0.0 END) AS fp FROM log GROUP BY 1),
        f AS (SELECT bucket, 'server_errors' AS condition, round(r5, 6) AS rate, r5 > 0.05 AS flag FROM s UNION ALL SELECT bucket, 'false_positives', round(fp, 6), fp > 0.1 FROM s)
        SELECT bucket, condition, rate, flag, (SELECT count(*) FROM f g WHERE g.condition = f.condition AND g.flag AND g.bucket BETWEEN f.bucket - 2 AND f.bucket) = 3 AS firing FROM f""",
    ("log",),
)
def _(t):
    false_alarm = ~F.col("is_attack") & (S.agent_suspicion(F.col("http_user_agent")) >= 1.0)
    series = reports.rate_series(t.log, HOUR, {"r5": F.col("status") >= 500, "fp": false_alarm})
    parts = []
    for name, column, limit in (("server_errors", "r5", 0.05), ("false_positives", "fp", 0.1)):
        one = reports.sustained(series.select("bucket", F.col(column).alias("rate")), F.col("rate") > limit, 2)
        parts.append(one.select("bucket", F.lit(name).alias("condition"), F.round("rate", 6).alias("rate"), "flag", "firing"))
    return parts[0].unionByName(parts[1])


@query(
    "agg31_silent_hours",
    f"""WITH h AS (SELECT unnest(range(lo, hi + 1)) AS bucket FROM (SELECT min(us // {HOUR}) AS lo, max(us // {HOUR}) AS hi FROM log)),
        c AS (SELECT us // {HOUR} AS bucket, count(*) AS n FROM alerts GROUP BY 1), f AS (SELECT bucket, coalesce(n, 0) = 0 AS flag FROM h LEFT JOIN c USING (bucket))
        SELECT bucket, flag, flag AND coalesce((SELECT count(*) FROM f g WHERE g.flag AND g.bucket BETWEEN f.bucket - 1 AND f.bucket), 0) = 2 AS firing FROM f""",
    ("alerts",),
)
def _(t):
    hour = features.bucket_of(F.col("us"), HOUR)
    span = t.log.agg(F.min(hour).alias("a"), F.max(hour).alias("b"))
    counted = t.alerts.groupBy(hour.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(F.explode(F.sequence("a", "b")).alias("bucket")).join(counted, "bucket", "left")
    return reports.sustained(grid, F.coalesce("n", F.lit(0)) == 0, 1).select("bucket", "flag", "firing")


_EDGE = "i / 10.0::DOUBLE * (len(s) - 1)"


@query(
    "agg31_drift_condition",
    f"""WITH r AS (SELECT us // {DAY} AS bucket, CAST(body_bytes_sent AS DOUBLE) AS value, us // {DAY} < (SELECT min(us // {DAY}) + 15 FROM log) AS early FROM log),
        edges AS (SELECT list_sort(list_distinct(list_transform(range(11), lambda i: s[CAST(floor({_EDGE}) AS BIGINT) + 1] + (s[CAST(ceil({_EDGE}) AS BIGINT) + 1] - s[CAST(floor({_EDGE}) AS BIGINT) + 1]) * ({_EDGE} - floor({_EDGE}))))) AS edges
          FROM (SELECT list(value ORDER BY value) AS s FROM r WHERE early)),
        placed AS (SELECT bucket, early, least(len(list_filter(edges, lambda e: e <= value)) - 1, len(edges) - 2) AS bin FROM r, edges WHERE value BETWEEN edges[1] AND edges[-1]),
        grid AS (SELECT bucket, bin FROM (SELECT DISTINCT bucket FROM placed WHERE NOT early), (SELECT unnest(range(len(edges) - 1)) AS bin FROM edges)),
        e AS (SELECT bin, count(*) AS e, sum(count(*)) OVER () AS te FROM placed WHERE early GROUP BY 1),
        a AS (SELECT bucket, bin, count(*) AS a, sum(count(*)) OVER (PARTITION BY bucket) AS ta FROM placed WHERE NOT early GROUP BY 1, 2),
        shares AS (SELECT bucket, greatest(coalesce(a, 0) / (max(ta) OVER (PARTITION BY bucket) + 1e-6::DOUBLE), 1e-6::DOUBLE) AS pa, greatest(coalesce(e, 0) / ((SELECT max(te) FROM e) + 1e-6::DOUBLE), 1e-6::DOUBLE) AS pe
          FROM grid LEFT JOIN a USING (bucket, bin) LEFT JOIN e USING (bin)),
        f AS (SELECT bucket, round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM shares GROUP BY 1)
        SELECT bucket, psi, psi > 0.02 AS flag, (SELECT count(*) FROM f g WHERE g.psi > 0.02 AND g.bucket BETWEEN f.bucket - 5 AND f.bucket) = 6 AS firing FROM f""",
    ("log",),
)
def _(t):
    """Held for five minutes, here days; the limit is a tenth of the usual 0.2, which these data never pass."""
    day = features.bucket_of(F.col("us"), DAY)
    early = day < t.log.agg(F.min(day) + F.lit(15)).scalar()
    series = reports.psi_series(t.log, F.col("body_bytes_sent"), early, DAY).withColumn("psi", F.round("psi", 6))
    return reports.sustained(series, F.col("psi") > 0.02, 5).select("bucket", "psi", "flag", "firing")


@query(
    "agg32_ingest_lag",
    """SELECT event_type, max(us) AS last_event_us, round(max(lag), 6) AS max_lag_seconds, round(avg(lag), 6) AS mean_lag_seconds
       FROM (SELECT event_type, us, (us + CAST(floor(request_time * 1000000) AS BIGINT) + k - us) / 1e6 AS lag FROM log) GROUP BY 1""",
    ("log",),
)
def _(t):
    done = t.log.withColumn("done_us", F.col("us") + F.floor(F.col("request_time") * 1000000) + F.col("k"))
    return reports.ingest_lag(done, "us", "done_us", ["event_type"]).select("event_type", "last_event_us", *r6("max_lag_seconds", "mean_lag_seconds"))


@query(
    "agg33_traffic_summary",
    """WITH newest AS (SELECT request_time FROM log ORDER BY us DESC LIMIT 200)
       SELECT count(*) AS total, 0::BIGINT AS errors, round((max(us) - min(us)) / 1e6, 6) AS elapsed_seconds, round(count(*) / ((max(us) - min(us)) / 1e6), 6) AS rate,
         (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM log GROUP BY 1)) AS status_counts,
         (SELECT round(avg(request_time) + 1e-9, 6) FROM newest) AS mean_last, (SELECT round(quantile_cont(request_time, 0.95) + 1e-9, 6) FROM newest) AS p95_last FROM log""",
    ("log",),
)
def _(t):
    return reports.traffic_summary(t.log).select("total", "errors", *r6("elapsed_seconds", "rate"), "status_counts", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean_last", "p95_last")])


@query(
    "agg34_window_extras",
    f"""SELECT ip, bucket, requests, round(byte_ratio, 6) AS byte_ratio, round(path_depth, 6) AS path_depth, round(auth_failure_rate, 6) AS auth_failure_rate,
          coalesce(burst, 0) AS connection_burst, round(ua_entropy, 6) AS ua_entropy, round(CASE WHEN sd > 0 THEN (requests - mu) / sd ELSE 0 END, 6) AS baseline_deviation
        FROM (SELECT *, avg(requests) OVER w AS mu, stddev_samp(requests) OVER w AS sd FROM (
          SELECT remote_addr AS ip, us // {DAY} AS bucket, count(*) AS requests, avg(body_bytes_sent) AS byte_ratio,
            avg(len(string_split(split_part(request_uri, '?', 1), '/')) - 1) AS path_depth,
            avg(CASE WHEN status IN (401, 403) AND request_uri = '/login' THEN 1.0 ELSE 0.0 END) AS auth_failure_rate FROM log GROUP BY 1, 2)
          LEFT JOIN (SELECT ip, bucket, max(n) AS burst FROM (SELECT remote_addr AS ip, us // {DAY} AS bucket, us // {DAY // 60} AS s, count(*) AS n FROM log
            WHERE us % {DAY} >= {DAY - DAY // 6} GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (ip, bucket)
          JOIN (SELECT ip, bucket, -sum(p * log2(p + 1e-12)) AS ua_entropy FROM (SELECT ip, bucket, n / sum(n) OVER (PARTITION BY ip, bucket) AS p FROM (
            SELECT remote_addr AS ip, us // {DAY} AS bucket, http_user_agent, count(*) AS n FROM log GROUP BY 1, 2, 3)) GROUP BY 1, 2) USING (ip, bucket)
          WINDOW w AS (PARTITION BY ip ORDER BY bucket RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING))""",
    ("log",),
)
def _(t):
    df = features.rolling_deviation(features.window_extras(t.log, DAY, DAY // 60, DAY // 6), "ip", "requests", 7)
    return df.select("ip", "bucket", "requests", "connection_burst", *r6("byte_ratio", "path_depth", "auth_failure_rate", "ua_entropy", "baseline_deviation"))


@query(
    "agg34_sessions",
    f"""SELECT remote_addr, session, min(us) AS start_us, max(us) AS end_us, count(*) AS requests, CAST(sum(body_bytes_sent) AS BIGINT) AS bytes FROM (
          SELECT *, CAST(sum(s) OVER (PARTITION BY remote_addr ORDER BY us) AS BIGINT) AS session FROM (
            SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY remote_addr ORDER BY us) <= {DAY // 2} THEN 0 ELSE 1 END AS s FROM log)) GROUP BY 1, 2""",
    ("log",),
)
def _(t):
    return features.sessions(t.log, "remote_addr", "us", DAY // 2, {"bytes": F.col("body_bytes_sent")})


@query(
    "agg34_unique_sources",
    f"SELECT us // {DAY} AS bucket, count(DISTINCT remote_addr) AS unique_ips, round(count(*) / 86400, 6) AS request_rate FROM log GROUP BY 1",
    ("log",),
)
def _(t):
    return t.log.groupBy(features.bucket_of(F.col("us"), DAY).alias("bucket")).agg(
        F.count_distinct("remote_addr").alias("unique_ips"), F.round(F.count(F.lit(1)) / 86400, 6).alias("request_rate")
    )


_TYPES = ("SQL Injection", "Brute Force", "DoS Flood", "Path Traversal", "Port Scan")


@query(
    "agg35_attack_slots",
    "SELECT (us % 86400000000) // 7200000000 AS slot, "
    + ", ".join(f"count(*) FILTER (WHERE attack_type = '{a}') AS {a.lower().replace(' ', '_')}" for a in _TYPES)
    + " FROM alerts GROUP BY 1",
    ("alerts",),
)
def _(t):
    return reports.slot_pivot(t.alerts, 7_200_000_000, _TYPES)


@query(
    "agg36_source_profiles",
    """SELECT source_ip, count(*) AS alerts, max(risk_score) AS risk, max(us) AS last_us,
         (SELECT attack_type FROM alerts b WHERE b.source_ip = a.source_ip GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS main_type FROM alerts a GROUP BY 1""",
    ("alerts",),
)
def _(t):
    return reports.source_profiles(t.alerts)


@query(
    "agg37_status_tally",
    "SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) AS total FROM alerts",
    ("alerts",),
)
def _(t):
    return reports.tally(t.alerts, "severity", ["CRITICAL", "HIGH"])
