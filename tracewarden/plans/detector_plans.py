"""Windowed and stateful detectors.  One reference minute is one day of the event tables."""

from pyspark.sql import functions as F

from tracewarden.functions import calibration as C
from tracewarden.functions import signatures as S
from tracewarden.operators import baseline, detectors, features, reports
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import DAY, search
from tracewarden.plans.signature_plans import hits
from tracewarden.session import cut_lineage


def learned_limit(t):
    """P99 + 3 sigma of requests per address and day.  The profile is learned once and stored as a one-row
    table, the rules read it as a scalar subquery."""
    freq = baseline.frequency_thresholds(baseline.requests_per_bucket(t.log, DAY))
    return cut_lineage(freq.select(F.round("threshold", 4).alias("threshold"))).scalar()


LIMIT = "(SELECT round(p99 + 3 * std, 4) FROM freq)"
RATE_FRAME = f"count(*) OVER (PARTITION BY remote_addr ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"
RATE_SQL = f"""SELECT event_id, remote_addr, us, 'rate_limit' AS rule, round(CAST(n AS DOUBLE), 2) AS req_per_min, round(least(n / lim, 1.0), 4) AS confidence,
  round(n / lim, 6) AS rate_ratio, 'high' AS severity, n AS window_requests FROM (SELECT *, {RATE_FRAME} AS n, {LIMIT} AS lim FROM log) WHERE n > lim"""


@query(
    "win01_login_brute_force",
    f"""SELECT event_id, remote_addr, us, 'login_brute_force' AS rule, n AS failures, round(least(n / 2, 1.0), 4) AS confidence, 'critical' AS severity FROM (
          SELECT *, {RATE_FRAME} AS n FROM log WHERE status IN (401, 403) AND {search('request_uri', S.AUTH_ENDPOINTS)}) WHERE n > 2""",
    ("log",),
)
def _(t):
    return detectors.login_brute_force(t.log, threshold=2, width_us=DAY)


@query("win02_rate_limit", RATE_SQL, ("log", "freq"))
def _(t):
    df = detectors.rate_limit(t.log, learned_limit(t), width_us=DAY, minute_us=DAY)
    return df.withColumn("rate_ratio", F.round("rate_ratio", 6))


@query(
    "rate_limit_severity_counts",
    f"""SELECT severity, CAST(sum(n) AS BIGINT) AS n, CAST((SELECT count(*) FROM r) AS BIGINT) AS total FROM (SELECT upper(severity) AS severity, count(*) AS n FROM r GROUP BY 1
          UNION ALL SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']), 0) GROUP BY 1""".replace("FROM r", f"FROM ({RATE_SQL})"),
    ("log", "freq"),
)
def _(t):
    return reports.severity_counts(detectors.rate_limit(t.log, learned_limit(t), width_us=DAY, minute_us=DAY))


@query(
    "win02_rate_limit_fixed",
    f"""SELECT event_id, remote_addr, us, n AS window_requests, round(n / 6.0, 6) AS rate_ratio, round(least(n / 6.0, 1.0), 4) AS confidence
        FROM (SELECT *, {RATE_FRAME} AS n FROM log) WHERE n > 6""",
    ("log",),
)
def _(t):
    """The same rule with a given limit, which many windows pass."""
    df = detectors.rate_limit(t.log, 6.0, width_us=DAY, minute_us=DAY)
    return df.select("event_id", "remote_addr", "us", "window_requests", F.round("rate_ratio", 6).alias("rate_ratio"), "confidence")


@query(
    "win03_flood_or_classify",
    f"""SELECT event_id, remote_addr, us, CASE WHEN n > lim THEN 'DoS Flood' ELSE attack_type END AS attack_type,
          CASE WHEN n > 3 * lim THEN 'CRITICAL' WHEN n > lim THEN 'HIGH' ELSE severity END AS severity, CASE WHEN n > lim THEN 'RATE_LIMIT_RULE' ELSE rule END AS rule,
          round(CASE WHEN n > lim THEN least(0.99, 0.6 + n / (lim * 5)) ELSE risk_score END, 6) AS risk_score,
          round(CASE WHEN n > lim THEN least(0.99, 0.65 + n / (lim * 5)) ELSE ml_score END, 6) AS ml_score FROM (
            SELECT l.event_id, l.remote_addr, l.us, attack_type, severity, rule, risk_score, ml_score, 6.0::DOUBLE AS lim,
              count(*) OVER (PARTITION BY l.remote_addr ORDER BY l.us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS n
            FROM log l LEFT JOIN alerts a ON a.event_id = l.event_id) WHERE n > lim OR rule IS NOT NULL""",
    ("alerts",),
)
def _(t):
    df = detectors.flood_or_classify(t.log, 6.0, width_us=DAY)
    return df.withColumns({"risk_score": F.round("risk_score", 6), "ml_score": F.round("ml_score", 6)})


def _spike_sql(partition):
    return f"""SELECT event_id, remote_addr, us, 'error_rate_spike' AS rule, CASE WHEN r5 > 0.2 THEN 'critical' ELSE 'high' END AS severity,
          round(least(greatest(CASE WHEN er > 0.3 THEN er / 0.3 ELSE 0 END, CASE WHEN r4 > 0.25 THEN r4 / 0.25 ELSE 0 END, CASE WHEN r5 > 0.1 THEN r5 / 0.1 ELSE 0 END) / 2, 1.0), 4) AS confidence,
          round(er, 4) AS error_rate, round(r4, 4) AS rate_4xx, round(r5, 4) AS rate_5xx, n AS window_size FROM (
            SELECT event_id, remote_addr, us, n, (e4 + e5) / n AS er, e4 / n AS r4, e5 / n AS r5 FROM (
              SELECT *, count(*) OVER w AS n, sum(CASE WHEN status BETWEEN 400 AND 499 THEN 1 ELSE 0 END) OVER w AS e4, sum(CASE WHEN status >= 500 THEN 1 ELSE 0 END) OVER w AS e5
              FROM log WINDOW w AS ({partition} ORDER BY us, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) WHERE n >= 10)
          WHERE er > 0.3 OR r4 > 0.25 OR r5 > 0.1"""


@query("win04_error_rate_spike", _spike_sql(""), ("log",))
def _(t):
    return detectors.error_rate_spike(t.log)


@query("win04_error_rate_spike_per_source", _spike_sql("PARTITION BY remote_addr"), ("log",))
def _(t):
    return detectors.error_rate_spike(t.log, keys=["remote_addr"])


_MULTI = " UNION ALL ".join(
    f"""SELECT event_id, remote_addr, us, n AS requests, {limit} AS threshold, '{label}' AS window_label, '{sev}' AS severity FROM (
          SELECT *, count(*) OVER (PARTITION BY remote_addr ORDER BY us RANGE BETWEEN {m * DAY} PRECEDING AND CURRENT ROW) AS n FROM log) WHERE n > {limit}"""
    for m, limit, label, sev in detectors.MULTI_WINDOWS
)


@query("win05_multi_window", _MULTI, ("log",))
def _(t):
    return detectors.multi_window(t.log, minute_us=DAY)


@query(
    "win06_window_state",
    "SELECT remote_addr, "
    + ", ".join(
        f"count(*) FILTER (WHERE hi - us <= {m * DAY}) AS count_{label}, {limit} AS threshold_{label}" for m, limit, label, _ in detectors.MULTI_WINDOWS
    )
    + " FROM log, (SELECT max(us) AS hi FROM log) GROUP BY 1",
    ("log",),
)
def _(t):
    return detectors.window_state(t.log, t.log.agg(F.max("us")).scalar(), minute_us=DAY)


ESTIMATES = """obs AS (SELECT event_id, remote_addr, us, status >= 400 AS bad, CASE WHEN status >= 400 THEN 3.1::DOUBLE ELSE 2.1 END AS rate,
    CASE WHEN status >= 400 THEN 1.0::DOUBLE ELSE 0.0 END AS err, CASE WHEN length(request_uri) - length(replace(request_uri, '/', '')) > 2 THEN 0.3::DOUBLE ELSE 1.8 END AS ent,
    row_number() OVER (PARTITION BY remote_addr ORDER BY us, event_id) AS rn FROM log),
  ema AS (SELECT event_id, remote_addr, rn, rate, err, ent, 2.1::DOUBLE AS er, 0.05::DOUBLE AS ee, 1.8::DOUBLE AS en FROM obs WHERE rn = 1
    UNION ALL SELECT o.event_id, o.remote_addr, o.rn, o.rate, o.err, o.ent, 0.1 * e.rate + 0.9 * e.er, 0.1 * e.err + 0.9 * e.ee, 0.1 * e.ent + 0.9 * e.en
    FROM ema e JOIN obs o ON o.remote_addr = e.remote_addr AND o.rn = e.rn + 1),
  prints AS (SELECT *, 0.5 * rate_z + 0.3 * error_z + 0.2 * entropy_z AS composite FROM (
    SELECT *, (rate - er) / (er * 0.3 + 0.1) AS rate_z, (err - ee) / 0.1 AS error_z, abs(ent - en) / 0.5 AS entropy_z FROM ema))"""


@query(
    "win07_behavioural_fingerprint",
    f"""WITH RECURSIVE {ESTIMATES} SELECT event_id, remote_addr, round(rate_z + 1e-9, 6) AS rate_z, round(error_z + 1e-9, 6) AS error_z, round(composite + 1e-9, 6) AS composite,
          composite > 5.0 AS anomalous, round(0.1 * rate + 0.9 * er + 1e-9, 6) AS baseline_rate FROM prints""",
    ("log",),
)
def _(t):
    df = detectors.behavioural_fingerprint(detectors.event_estimates(t.log))
    return df.select("event_id", "remote_addr", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("rate_z", "error_z", "composite", "baseline_rate")], "anomalous")


DYNAMIC = """greatest(avg(rate) OVER g + 3 * sqrt(CASE WHEN count(*) OVER g > 1 THEN
    (0.49 + coalesce(var_samp(rate) OVER g, 0) * (count(*) OVER g - 1)) / (count(*) OVER g - 1) ELSE 0.49 END), 1.0)"""


@query(
    "win08_dynamic_threshold",
    f"""SELECT event_id, round({DYNAMIC}, 6) AS dynamic_threshold FROM (SELECT event_id, us, CASE WHEN status >= 400 THEN 3.1::DOUBLE ELSE 2.1 END AS rate FROM log)
        WINDOW g AS (ORDER BY us, event_id)""",
    ("log",),
)
def _(t):
    df = detectors.dynamic_threshold(detectors.event_estimates(t.log))
    return df.select("event_id", F.round("dynamic_threshold", 6).alias("dynamic_threshold"))


@query(
    "win09_adaptive_decision",
    f"""WITH RECURSIVE {ESTIMATES}, dyn AS (SELECT event_id, {DYNAMIC} AS dynamic_threshold FROM obs WINDOW g AS (ORDER BY us, event_id)),
        mw AS (SELECT event_id, count(*) AS windows FROM ({_MULTI}) GROUP BY 1),
        j AS (SELECT l.event_id, l.remote_addr, value / 500 AS ml, coalesce(windows, 0) AS windows, composite, composite > 5.0 AS anomalous, dynamic_threshold
          FROM log l JOIN prints USING (event_id) JOIN dyn USING (event_id) LEFT JOIN mw USING (event_id)),
        k AS (SELECT *, 0.4::DOUBLE * least(windows * 0.3, 1.0) + 0.3::DOUBLE * CASE WHEN anomalous THEN least(composite / 10, 1.0) ELSE 0.0 END + 0.3::DOUBLE * least(greatest(ml, 0.0), 1.0) AS risk FROM j)
        SELECT event_id, remote_addr, risk > 0.7 AS alerted, CASE WHEN risk > 0.9 THEN 'critical' WHEN risk > 0.7 THEN 'high' WHEN risk > 0.5 THEN 'medium' ELSE 'info' END AS severity,
          round(risk, 3) AS risk_score, round(dynamic_threshold, 2) AS dynamic_threshold, concat_ws('; ', CASE WHEN windows > 0 THEN printf('multi_window (%d windows)', windows) END,
            CASE WHEN anomalous THEN printf('behavioral (score=%.1f)', composite) END, CASE WHEN ml > 0.5 THEN printf('ml_score=%.2f', ml) END) AS signals FROM k""",
    ("log",),
)
def _(t):
    df = detectors.adaptive_decision(t.log, F.col("value") / 500, minute_us=DAY)
    return df.withColumn("signals", F.array_join("signals", "; "))


CONFIRM = "(PARTITION BY entity_id ORDER BY us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(
    "win10_temporal_confirmation",
    f"""SELECT event_id, entity_id, hits, n AS frame_rows, n = 10 AND hits >= 4 AS escalated, round(hits / n, 6) AS anomaly_rate FROM (
          SELECT event_id, entity_id, CAST(sum(y_hybrid) OVER w AS BIGINT) AS hits, count(*) OVER w AS n FROM judged WINDOW w AS {CONFIRM})""",
    ("judged",),
)
def _(t):
    df = detectors.confirm(t.judged, F.col("y_hybrid") == 1)
    return df.select("event_id", "entity_id", "hits", "frame_rows", "escalated", F.round("anomaly_rate", 6).alias("anomaly_rate"))


def _fold_sql(source, entity, category, span, closes, columns):
    """Recursive groups over ``source``: one step per position of a key, all keys at once."""
    restart = f"g.us - g.anchor >= {span}" if closes else f"o.us - g.anchor > {span}"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {entity}, {category} ORDER BY us, event_id) AS rn FROM ({source})),
      g AS (SELECT {columns}, us, rn, us AS anchor, 1::BIGINT AS seq FROM o WHERE rn = 1 UNION ALL
        SELECT {', '.join('o.' + c.strip() for c in columns.split(','))}, o.us, o.rn, CASE WHEN {restart} THEN o.us ELSE g.anchor END, CASE WHEN {restart} THEN 1 ELSE g.seq + 1 END
        FROM g JOIN o ON o.{entity} = g.{entity} AND o.{category} = g.{category} AND o.rn = g.rn + 1)"""


QUIET = 5 * DAY
_SUPPRESS = _fold_sql("SELECT event_id, us, source_ip, attack_type FROM alerts", "source_ip", "attack_type", QUIET, False, "event_id, source_ip, attack_type")


@query(
    "win11_alert_suppression",
    f"WITH RECURSIVE {_SUPPRESS} SELECT event_id, source_ip, attack_type, anchor AS anchor_us, seq AS group_seq, seq >= 3 AS suppressed FROM g",
    ("alerts",),
)
def _(t):
    return suppressed_alerts(t).drop("us")


def suppressed_alerts(t, after=3, quiet=QUIET, keys=("source_ip", "attack_type")):
    return detectors.suppress(t.alerts.select("event_id", "us", *keys), keys=list(keys), order=["us", "event_id"], suppress_after=after, quiet_us=quiet)


@query(
    "win12_suppression_stats",
    f"""WITH RECURSIVE {_SUPPRESS} SELECT count(*) AS total_tracked, count(*) FILTER (WHERE seq >= 3) AS currently_suppressed FROM (
          SELECT source_ip, attack_type, max(rn) AS rn FROM g GROUP BY 1, 2) JOIN g USING (source_ip, attack_type, rn)""",
    ("alerts",),
)
def _(t):
    return detectors.suppression_stats(suppressed_alerts(t), ["source_ip", "attack_type"])


_LEVEL = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"


@query(
    "win13_incidents",
    f"""WITH RECURSIVE {_fold_sql('SELECT * FROM alerts', 'source_ip', 'attack_type', 2 * DAY, True, 'event_id, source_ip, attack_type, risk_score, severity')}
        SELECT 'INC-' || substr(md5(source_ip || '|' || attack_type || '|' || anchor), 1, 12) AS incident_id, source_ip, attack_type, anchor AS first_seen_us, max(us) AS last_seen_us,
          count(*) AS alert_count, max(risk_score) AS max_score, ['low', 'medium', 'high', 'critical'][max({_LEVEL})] AS severity, max(us) - anchor >= {2 * DAY} AS closed
        FROM g GROUP BY source_ip, attack_type, anchor""",
    ("alerts",),
)
def _(t):
    rank = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    return detectors.incidents(
        t.alerts.select("event_id", "us", "source_ip", "attack_type", "severity", "risk_score"),
        entity="source_ip", category="attack_type", order=["us", "event_id"], score="risk_score", level_rank=rank, names=C.LEVEL_ORDER, span_us=2 * DAY,
    )


@query(
    "win14_rule_suppression",
    f"""WITH RECURSIVE {_fold_sql('SELECT event_id, us, source_ip, rule FROM alerts', 'source_ip', 'rule', DAY, False, 'event_id, source_ip, rule')}
        SELECT event_id, source_ip, rule, seq >= 2 AS suppressed FROM g""",
    ("alerts",),
)
def _(t):
    return suppressed_alerts(t, 2, DAY, ("source_ip", "rule")).select("event_id", "source_ip", "rule", "suppressed")


@query(
    "win15_slow_and_low",
    f"""SELECT entity_id, count(*) FILTER (WHERE bad) AS true_attacks, count(*) FILTER (WHERE bad AND y_ml = 1) AS ml, count(*) FILTER (WHERE bad AND rule_triggered) AS rule,
          count(*) FILTER (WHERE bad AND z >= 2.5) AS behavior, count(*) FILTER (WHERE bad AND esc) AS hybrid,
          round(count(*) FILTER (WHERE bad AND esc) / greatest(count(*) FILTER (WHERE bad), 1), 6) AS detection_rate,
          round((min(us) FILTER (WHERE bad AND esc) - min(us) FILTER (WHERE bad)) / 1e6, 6) AS delay_seconds
        FROM (SELECT *, y_true = 1 AS bad, count(*) OVER w = 10 AND sum(y_hybrid) OVER w >= 4 AS esc FROM judged WINDOW w AS {CONFIRM}) GROUP BY 1""",
    ("judged",),
)
def _(t):
    df = detectors.slow_and_low(
        t.judged, F.col("y_hybrid") == 1, F.col("y_ml") == 1, F.col("rule_triggered"), F.col("z") >= 2.5, F.col("y_true") == 1
    )
    return df.withColumns({"detection_rate": F.round("detection_rate", 6), "delay_seconds": F.round("delay_seconds", 6)})


@query(
    "win16_cross_source",
    f"""SELECT regexp_extract(remote_addr, '^([0-9]+[.][0-9]+[.][0-9]+)', 1) AS subnet, split_part(request_uri, '?', 1) AS path, us // {DAY} AS bucket,
          count(DISTINCT remote_addr) AS sources, count(*) AS requests FROM log GROUP BY 1, 2, 3 HAVING count(DISTINCT remote_addr) >= 10""",
    ("log",),
)
def _(t):
    return detectors.cross_source(t.log, width_us=DAY, min_sources=10)


@query(
    "win17_reassembled_requests",
    f"""SELECT event_id, remote_addr, assembled, hits, round(least(0.5::DOUBLE + 0.17 * hits, 1.0), 4) AS confidence, CASE WHEN 0.5::DOUBLE + 0.17 * hits >= 0.85 THEN 'critical' ELSE 'high' END AS severity
        FROM (SELECT *, {hits("(assembled || ' -')", S.SQLI_SIGNATURES)} AS hits FROM (
          SELECT event_id, remote_addr, array_to_string(list_transform(list_filter(recent, lambda x: us - x.us <= {5 * DAY}), lambda x: x.uri), '') AS assembled FROM (
            SELECT event_id, remote_addr, us, list({{'us': us, 'uri': request_uri}}) OVER (PARTITION BY remote_addr ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM log)))
        WHERE hits > 0""",
    ("log",),
)
def _(t):
    return detectors.assembled_requests(t.log, span_us=5 * DAY)


# four in five requests of the log carry a piece of a payload, so that it shows in whole sessions only
PIECES = ("/a?q=1 UNI", "ON ALL ", "/b?c=SEL", "ECT x FR", "OM users")


@query(
    "win17_session_payloads",
    f"""SELECT remote_addr, start_us, end_us, requests, hits, round(least(0.5::DOUBLE + 0.17 * hits, 1.0), 4) AS confidence, CASE WHEN 0.5::DOUBLE + 0.17 * hits >= 0.85 THEN 'critical' ELSE 'high' END AS severity
        FROM (SELECT *, {hits("(assembled || ' -')", S.SQLI_SIGNATURES)} AS hits FROM (
          SELECT remote_addr, min(us) AS start_us, max(us) AS end_us, count(*) AS requests, string_agg(uri, '' ORDER BY us, event_id) AS assembled FROM (
            SELECT *, sum(s) OVER (PARTITION BY remote_addr ORDER BY us, event_id) AS session FROM (
              SELECT event_id, remote_addr, us, CASE event_id % 7 WHEN 0 THEN '{PIECES[0]}' WHEN 1 THEN '{PIECES[1]}' WHEN 2 THEN '{PIECES[2]}' WHEN 3 THEN '{PIECES[3]}' WHEN 4 THEN '{PIECES[4]}' ELSE request_uri END AS uri,
                CASE WHEN us - lag(us) OVER (PARTITION BY remote_addr ORDER BY us, event_id) <= {DAY} THEN 0 ELSE 1 END AS s FROM log))
          GROUP BY remote_addr, session)) WHERE hits > 0""",
    ("log",),
)
def _(t):
    at = F.col("event_id") % 7
    uri = F.col("request_uri")
    for k, p in enumerate(PIECES):
        uri = F.when(at == k, p).otherwise(uri)
    return detectors.session_payloads(t.log.withColumn("request_uri", uri), gap_us=DAY, piece=512, reach=128)


@query(
    "win18_rule_set",
    f"""SELECT l.event_id, c IS NOT NULL AS detected, coalesce(c, 0.0) AS score, coalesce(r, 0) AS rules FROM log l LEFT JOIN (
          SELECT event_id, max(confidence) AS c, count(DISTINCT rule) AS r FROM (
            SELECT event_id, 'sql_injection' AS rule, round(least(0.5::DOUBLE + 0.17 * h, 1.0), 4) AS confidence FROM (SELECT event_id, {hits("(request_uri || ' ' || http_referer)", S.SQLI_SIGNATURES)} AS h FROM log) WHERE h > 0
            UNION ALL SELECT event_id, 'path_traversal', round(least(0.6::DOUBLE + 0.1 * h + CASE WHEN status = 200 THEN 0.25 ELSE 0 END, 1.0), 4) FROM (SELECT event_id, status, {hits('request_uri', S.TRAVERSAL_SIGNATURES)} AS h FROM log) WHERE h > 0
            UNION ALL SELECT event_id, 'login_brute_force', 1.0 FROM (SELECT *, {RATE_FRAME} AS n FROM log WHERE status IN (401, 403) AND request_uri = '/login') WHERE n > 2
            UNION ALL SELECT event_id, rule, confidence FROM ({RATE_SQL}) UNION ALL SELECT event_id, rule, confidence FROM ({_spike_sql('')})) GROUP BY 1) d ON d.event_id = l.event_id""",
    ("log", "freq"),
)
def _(t):
    found = detectors.rule_set(t.log, rate_threshold=learned_limit(t), auth_threshold=2, width_us=DAY, minute_us=DAY)
    return detectors.any_rule(t.log, found)


@query(
    "win20_threat_rules",
    f"""WITH w AS (SELECT ip, bucket, f3_failed_request_ratio AS f3, f6_unique_endpoints_per_min AS f6, event_count AS n, auth, CASE WHEN sd > 0 THEN (event_count - mu) / sd ELSE 0 END AS dev FROM (
          SELECT f.*, a.auth, avg(event_count) OVER v AS mu, stddev_samp(event_count) OVER v AS sd FROM features f JOIN (
            SELECT remote_addr AS ip, us // {DAY} AS bucket, avg(CASE WHEN status IN (401, 403) AND request_uri = '/login' THEN 1.0 ELSE 0.0 END) AS auth FROM log GROUP BY 1, 2) a USING (ip, bucket)
          WINDOW v AS (PARTITION BY ip ORDER BY bucket RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)))
        SELECT ip, bucket, 'port_scan' AS rule FROM w WHERE f6 > 50 UNION ALL SELECT ip, bucket, 'brute_force' FROM w WHERE f3 > 0.6 AND n > 2
        UNION ALL SELECT ip, bucket, 'slow_and_low' FROM w WHERE dev > 2.5 UNION ALL SELECT ip, bucket, 'credential_stuffing' FROM w WHERE n > 2 AND auth > 0.3""",
    ("features",),
)
def _(t):
    extras = features.rolling_deviation(features.window_extras(t.log, DAY), "ip", "requests", 7)
    windows = features.behaviour_features(t.log, DAY).join(extras, ["ip", "bucket"])
    return detectors.threat_rules(windows.withColumns({"frequency_limit": F.lit(2), "auth_limit": F.lit(0.3)}))
