"""Sources and sinks."""

import os
import uuid

from pyspark.sql import functions as F

from tracewarden.operators import cleanup
from tracewarden.plans.registry import query
from tracewarden.sources import files
from tracewarden.sources.tables import DAY
from tracewarden.session import shared_dir


def workdir(t) -> str:
    """A new folder next to the checkpoints for tables a query writes and reads back."""
    return os.path.join(shared_dir(t.spark), f"run-{uuid.uuid4().hex}")


def log_lines(t):
    return t.log.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "remote_addr", "request_method", "request_uri",
        F.col("status").cast("string").alias("status"),
        F.col("body_bytes_sent").cast("string").alias("body_bytes_sent"),
        "http_referer", "http_user_agent", "request_time",
    )


@query(
    "src01_json_access_log",
    """SELECT remote_addr, count(*) AS n, CAST(sum(status) AS BIGINT) AS status_sum, 0::BIGINT AS corrupt FROM log GROUP BY 1
       UNION ALL SELECT '(corrupt)', count(*), NULL, count(*) FROM log WHERE k = 0""",
    ("log",),
)
def _(t):
    path = workdir(t)
    good = log_lines(t).select(F.to_json(F.struct("*")).alias("value"))
    bad = t.log.filter("k = 0").select(F.concat(F.lit("{broken "), F.col("event_id").cast("string")).alias("value"))
    good.unionByName(bad).write.text(path)
    read = files.read_access_log(t.spark, path)
    key = F.when(F.col("_corrupt_record").isNotNull(), "(corrupt)").otherwise(F.col("remote_addr"))
    return read.groupBy(key.alias("remote_addr")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("status").try_cast("long")).alias("status_sum"),
        F.count("_corrupt_record").alias("corrupt"),
    )


@query(
    "src02_shipped_log",
    """SELECT event_id, CASE WHEN k % 17 = 3 THEN NULL ELSE status END AS status, CAST(body_bytes_sent AS INTEGER) AS body_bytes_sent,
         CASE WHEN k % 17 = 3 THEN NULL WHEN status >= 500 THEN '5xx' WHEN status >= 400 THEN '4xx' WHEN status >= 300 THEN '3xx' ELSE '2xx' END AS status_class
       FROM log WHERE k % 19 NOT IN (4, 5)""",
    ("log",),
)
def _(t):
    k = F.col("k")
    raw = t.log.select(
        "event_id",
        F.when(k % 19 == 4, "/health").when(k % 19 == 5, "/nginx-status").otherwise(F.col("request_uri")).alias("request_uri"),
        F.when(k % 17 == 3, "n/a").otherwise(F.col("status").cast("string")).alias("status"),
        F.col("body_bytes_sent").cast("string").alias("body_bytes_sent"),
    )
    return cleanup.shipped_log(raw).select("event_id", "status", "body_bytes_sent", "status_class")


@query(
    "src03_daily_rolled_sink",
    "SELECT strftime(ts, '%Y.%m.%d') AS day, count(*) AS n, CAST(sum(body_bytes_sent) AS BIGINT) AS bytes FROM log GROUP BY 1",
    ("log",),
)
def _(t):
    path = workdir(t)
    files.write_daily(t.log.select("ts", "body_bytes_sent"), path)
    return (
        t.spark.read.parquet(path)
        .groupBy(F.date_format("event_date", "yyyy.MM.dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("body_bytes_sent").alias("bytes"))
    )


@query(
    "src04_idempotent_alert_sink",
    "SELECT source_ip, count(*) AS alerts FROM alerts GROUP BY 1",
    ("alerts",),
)
def _(t):
    path = workdir(t)
    keyed = files.with_alert_key(t.alerts.drop("alert_id"), "event_id", "rule")
    doubled = keyed.unionByName(keyed)  # a producer that sends everything twice
    for replay in (0, 1):
        files.write_alert_batch(doubled, path, batch_id=7)
    return t.spark.read.parquet(path).groupBy("source_ip").agg(F.count_distinct("alert_id").alias("alerts"))


@query(
    "src05_history_scan",
    """SELECT us, remote_addr, request_method, request_uri, status, body_bytes_sent, round(request_time, 6) AS request_time, http_user_agent, http_referer
       FROM log ORDER BY us""",
    ("log",),
)
def _(t):
    columns = ["us", "remote_addr", "request_method", "request_uri", "status", "body_bytes_sent", "request_time", "http_user_agent", "http_referer"]
    return files.scan_history(t.log, columns).withColumn("request_time", F.round("request_time", 6))


@query(
    "src05_history_pages",
    "SELECT event_id, us, remote_addr, status, (row_number() OVER (ORDER BY us, event_id) - 1) // 1000 AS page FROM log",
    ("log",),
)
def _(t):
    path = workdir(t)
    files.page_history(t.log, ["us", "event_id", "remote_addr", "status"], 1000, path)
    return t.spark.read.parquet(path).withColumn("page", F.col("page").cast("long"))


@query(
    "src07_event_list_defaults",
    """SELECT event_id, src_ip, bytes_in, 0 AS bytes_out, 0 AS dst_port, '' AS domain, 0 AS is_nxdomain, 0 AS failed_login,
         0 AS fortiguard_hit, 0.0::DOUBLE AS cvss_score, 0 AS is_vuln FROM flows""",
    ("flows",),
)
def _(t):
    return cleanup.fill_missing(t.flows.select("event_id", "src_ip", "bytes_in"))


@query(
    "src08_labelled_csv",
    "SELECT y_true AS label, count(*) AS n, round(avg(ml_score), 6) AS ml_mean, round(avg(rule_score), 6) AS rule_mean FROM judged GROUP BY 1",
    ("judged",),
)
def _(t):
    path = workdir(t)
    t.judged.select("ml_score", F.col("z").alias("z_score"), "rule_score", F.col("y_true").alias("label")).write.option("header", True).csv(path)
    return files.read_labelled_scores(t.spark, path).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ml_score"), 6).alias("ml_mean"), F.round(F.avg("rule_score"), 6).alias("rule_mean")
    )


@query(
    "src09_profile_roundtrip",
    """SELECT round(f.p99 + 3 * f.std, 4) AS rate_limit_req_per_min, round(6 * s.error_rate, 6) AS error_rate_threshold,
         0.25::DOUBLE AS rate_4xx_threshold, 0.10::DOUBLE AS rate_5xx_threshold, 1.0::DOUBLE AS entropy_scan_threshold
       FROM freq f, status_mix s""",
    ("freq", "status_mix"),
)
def _(t):
    from tracewarden.operators import baseline

    path = workdir(t)
    freq = baseline.frequency_thresholds(baseline.requests_per_bucket(t.log, DAY))
    status = baseline.status_distribution(t.log)
    files.save_profile(
        freq.select(F.round("threshold", 4).alias("rate_limit_req_per_min"), F.round(status.select("threshold_error_rate").scalar(), 6).alias("error_rate_threshold")),
        path,
    )
    return files.load_thresholds(t.spark, path)


@query(
    "src10_result_export",
    "SELECT severity, count(*) AS n FROM alerts GROUP BY 1",
    ("alerts",),
)
def _(t):
    path = workdir(t)
    files.export_json(t.alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), path)
    return t.spark.read.schema("severity string, n long").json(path)


@query(
    "src11_graph_snapshot",
    """SELECT 'edges' AS part, count(*) AS n FROM flows UNION ALL
       SELECT 'vertices', count(*) FROM (SELECT src_ip FROM flows UNION SELECT dst_ip FROM flows) UNION ALL SELECT 'never written', 0""",
    ("flows",),
)
def _(t):
    from tracewarden.operators import graph

    path = workdir(t)
    vertices, edges = graph.ingest_edges(t.flows, "src_ip", "dst_ip", order="us")
    files.save_graph(vertices, edges, path, "v1")
    ddl = ("id string, type string", "src string, dst string, weight double")
    v, e = files.load_graph(t.spark, path, "v1", *ddl)
    none, _ = files.load_graph(t.spark, path, "v0", *ddl)
    counted = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return counted("edges", e).unionByName(counted("vertices", v)).unionByName(counted("never written", none))


@query(
    "src12_retention",
    f"SELECT us // {DAY} AS bucket, count(*) AS n FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 7 DAY GROUP BY 1",
    ("log",),
)
def _(t):
    kept = files.retain_days(t.log, 7, t.log.agg(F.max("ts")).scalar())
    return kept.groupBy(F.floor(F.col("us") / DAY).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src12_dropped_days",
    f"SELECT us // {DAY} AS day, count(*) AS n FROM log WHERE us // {DAY} >= (SELECT max(us // {DAY}) FROM log) - 7 GROUP BY 1",
    ("log",),
)
def _(t):
    """Days stored as partitions, old ones removed from the store."""
    path = f"{workdir(t)}/by-day"
    day = F.floor(F.col("us") / DAY)
    t.log.select("event_id", day.alias("day")).write.partitionBy("day").parquet(path)
    files.drop_old_days(t.spark, path, 7, t.log.agg(F.max(day)).first()[0])
    return t.spark.read.parquet(path).groupBy(F.col("day").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src13_packet_log_lines",
    """SELECT '[' || us || '] TCP ' || src_ip || ':' || dst_port || ' -> ' || dst_ip || ' LEN=' || bytes_in || ' ' ||
         CASE WHEN failed_login = 1 THEN 'RST' ELSE 'ACK' END AS value FROM flows""",
    ("flows",),
)
def _(t):
    return files.packet_lines(
        t.flows.select(
            F.col("us").cast("string").alias("timestamp"), F.lit("TCP").alias("protocol"), "src_ip", F.col("dst_port").alias("port"),
            "dst_ip", F.col("bytes_in").alias("length"), F.when(F.col("failed_login") == 1, "RST").otherwise("ACK").alias("flags"),
        )
    )
