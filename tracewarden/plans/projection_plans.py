"""Projections, filters and orderings."""

from pyspark.sql import functions as F

from tracewarden.operators import cleanup
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import DAY


def raw_frame(t):
    """The log as text with gaps: some unparsable times and numbers, some missing fields."""
    k = F.col("k")
    return t.log.select(
        "event_id",
        F.when(k % 23 == 1, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("timestamp"),
        F.when(k % 29 == 2, "bad").otherwise(F.col("status").cast("string")).alias("status"),
        F.when(k % 31 == 3, "").otherwise(F.col("body_bytes_sent").cast("string")).alias("body_bytes_sent"),
        F.col("request_time").cast("string").alias("request_time"),
        F.when(k % 37 != 4, F.col("remote_addr")).alias("remote_addr"),
        F.when(k % 41 != 5, F.col("request_uri")).alias("request_uri"),
        F.when(k % 43 != 6, F.col("http_user_agent")).alias("http_user_agent"),
    )


@query(
    "prj01_prepared_log",
    """SELECT event_id, us, CASE WHEN k % 29 = 2 THEN NULL ELSE CAST(status AS DOUBLE) END AS status,
         CASE WHEN k % 31 = 3 THEN NULL ELSE CAST(body_bytes_sent AS DOUBLE) END AS body_bytes_sent,
         round(request_time, 6) AS request_time, CASE WHEN k % 37 = 4 THEN 'unknown' ELSE remote_addr END AS remote_addr,
         CASE WHEN k % 41 = 5 THEN '/' ELSE request_uri END AS request_uri,
         CASE WHEN k % 43 = 6 THEN '-' ELSE http_user_agent END AS http_user_agent FROM log WHERE k % 23 <> 1""",
    ("log",),
)
def _(t):
    df = cleanup.prepared_log(raw_frame(t))
    return df.withColumn("us", F.unix_micros("timestamp")).withColumn("request_time", F.round("request_time", 6)).drop("timestamp")


@query(
    "prj02_time_and_error_columns",
    """SELECT event_id, us // 60000000 * 60000000 AS minute_us, us // 3600000000 * 3600000000 AS hour_us,
         status BETWEEN 400 AND 499 AS is_4xx, status BETWEEN 500 AND 599 AS is_5xx, status >= 400 AS is_error FROM log""",
    ("log",),
)
def _(t):
    df = cleanup.time_and_error_columns(t.log, "ts")
    return df.select("event_id", F.unix_micros("minute").alias("minute_us"), F.unix_micros("hour").alias("hour_us"), "is_4xx", "is_5xx", "is_error")


@query(
    "prj03_field_aliases",
    """SELECT event_id, remote_addr, CASE WHEN k % 7 = 0 THEN 'GET' ELSE request_method END AS request_method,
         CASE WHEN k % 3 = 0 THEN '' ELSE request_uri END AS request_uri, 200 AS status, http_user_agent, body_bytes_sent FROM log""",
    ("log",),
)
def _(t):
    k = F.col("k")
    other = t.log.select(
        "event_id",
        F.when(k % 2 == 0, F.col("remote_addr")).alias("remote_addr"),
        F.when(k % 2 != 0, F.col("remote_addr")).alias("clientip"),
        F.when(k % 7 != 0, F.col("request_method")).alias("verb"),
        F.when(k % 3 != 0, F.col("request_uri")).alias("request"),
        F.col("http_user_agent").alias("agent"),
        F.col("body_bytes_sent").alias("bytes"),
    )
    return cleanup.with_aliases(other).select("event_id", "remote_addr", "request_method", "request_uri", "status", "http_user_agent", "body_bytes_sent")


@query(
    "prj04_alert_records",
    "SELECT alert_id, source_ip, attack_type, severity, status, rule, risk_score, ml_score, message FROM alerts",
    ("alerts",),
)
def _(t):
    return t.alerts.select("alert_id", "source_ip", "attack_type", "severity", "status", "rule", "risk_score", "ml_score", "message")


@query(
    "prj05_latest_alerts",
    f"""SELECT alert_id, us, source_ip, attack_type, severity FROM alerts WHERE us >= (SELECT max(us) FROM alerts) - {DAY}
        ORDER BY us DESC, alert_id DESC LIMIT 50""",
    ("alerts",),
)
def _(t):
    return cleanup.latest(t.alerts, "us", DAY, 50, ["alert_id", "us", "source_ip", "attack_type", "severity"], "alert_id")


@query(
    "prj06_latest_packets",
    """SELECT event_id, us, src_ip, dst_ip, dst_port, bytes_in FROM flows WHERE us >= (SELECT max(us) FROM flows) - 3600000000
       ORDER BY us DESC, event_id DESC LIMIT 100""",
    ("flows",),
)
def _(t):
    return cleanup.latest(t.flows, "us", 3_600_000_000, 100, ["event_id", "us", "src_ip", "dst_ip", "dst_port", "bytes_in"], "event_id")


@query("prj07_severity_filter", "SELECT alert_id, severity FROM alerts WHERE severity = 'HIGH'", ("alerts",))
def _(t):
    return cleanup.severity_is(t.alerts, "high").select("alert_id", "severity")


@query(
    "prj08_alert_search",
    """SELECT alert_id, source_ip, attack_type FROM alerts
       WHERE (contains(source_ip, 'INJ') OR contains(lower(attack_type), 'inj')) AND severity = 'CRITICAL'""",
    ("alerts",),
)
def _(t):
    return cleanup.search_alerts(t.alerts, "INJ", "CRITICAL").select("alert_id", "source_ip", "attack_type")


@query(
    "prj09_multi_select",
    """SELECT alert_id, us FROM alerts WHERE severity IN ('CRITICAL', 'MEDIUM') AND attack_type IN ('SQL Injection', 'Port Scan')
       ORDER BY us DESC LIMIT 200""",
    ("alerts",),
)
def _(t):
    picked = cleanup.select_alerts(t.alerts, ["CRITICAL", "MEDIUM"], ["SQL Injection", "Port Scan"])
    return picked.orderBy(F.desc("us")).limit(200).select("alert_id", "us")


@query("prj10_host_search", "SELECT s_suppkey, s_name FROM supplier WHERE contains(CAST(s_suppkey AS VARCHAR), '42') OR contains(s_name, '42')")
def _(t):
    hosts = t.read("supplier").select("s_suppkey", "s_name", F.col("s_suppkey").cast("string").alias("id"))
    return cleanup.search_hosts(hosts, "42", ["id", "s_name"]).drop("id")


@query("prj11_alerts_by_score", "SELECT alert_id, risk_score, us FROM alerts ORDER BY risk_score DESC, us", ("alerts",))
def _(t):
    return t.alerts.select("alert_id", "risk_score", "us").orderBy(F.desc("risk_score"), "us")


@query("prj12_score_series", "SELECT us, risk_score FROM alerts ORDER BY us", ("alerts",))
def _(t):
    return t.alerts.select("us", "risk_score").orderBy("us")


@query(
    "prj13_contributions_by_magnitude",
    """SELECT event_id, string_agg(feature, '>' ORDER BY abs(value) DESC, feature) AS ranking FROM (
         SELECT event_id, 'ml' AS feature, round(ml_raw, 6) AS value FROM scored UNION ALL SELECT event_id, 'behavior', round(z - 0.25, 6) FROM scored
         UNION ALL SELECT event_id, 'drift', -drift FROM scored) GROUP BY 1""",
    ("scored",),
)
def _(t):
    item = lambda n, v: F.struct(F.lit(n).alias("feature"), v.alias("value"))
    parts = F.array(
        item("ml", F.round("ml_raw", 6)), item("behavior", F.round(F.col("z") - 0.25, 6)), item("drift", -F.col("drift"))
    )
    ranked = F.transform(cleanup.by_magnitude(parts), lambda x: x["feature"])
    return t.scored.select("event_id", F.array_join(ranked, ">").alias("ranking"))
