"""Streaming queries over the whole event table, fed in five pages out of order, with a restart after each.

A row's page is that of its time plus a delay drawn from its id, up to the watermark's: rows come late, as late as
the watermark allows, and never in order.  The last page carries one marker row far in the future, which moves the
watermark past every real event so that append mode emits all of them; the marker itself is filtered from the results.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators import detectors
from tracewarden.operators.features import FEATURES
from tracewarden.plans.detector_plans import CONFIRM, ESTIMATES, QUIET, _SUPPRESS, _fold_sql
from tracewarden.plans.registry import query
from tracewarden.plans.sources_plans import workdir
from tracewarden.plans.sql_views import DAY
from tracewarden.session import cut_lineage
from tracewarden.streaming import jobs

MARKER = "marker"
DELAY_DAYS, PAGES, PAGE_US = 2, 5, 6 * DAY
#: A page is a micro-batch; more files than this would be several.
FILES = 10_000
WATERMARK = f"{DELAY_DAYS} days"


END_US = 9_183_110_400_000_000  # 2261-01-01: later than the end of the input, within the range of pandas times


def pages(t, df, key):
    """Pages in order of arrival, each shuffled; the last one with the marker row.

    The rows are derived once and dealt to a folder a page."""
    drawn = F.xxhash64("event_id")
    arrival = F.col("us") - t.log.agg(F.min("us")).scalar() + F.pmod(drawn, F.lit(DELAY_DAYS * DAY))
    folder = workdir(t)
    df.withColumn("_page", F.least(F.greatest(F.floor(arrival / PAGE_US), F.lit(0)), F.lit(PAGES - 1)).cast("int")).write.partitionBy("_page").parquet(folder)
    dealt = t.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_page", T.IntegerType())])).parquet(folder)
    late = {
        "us": F.lit(END_US), "event_id": F.lit(-1), key: F.lit(MARKER), "ts": F.timestamp_micros(F.lit(END_US)),
    }
    marker = t.spark.range(1).select(*[late.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    for page in range(PAGES):
        part = dealt.where(F.col("_page") == page).drop("_page").repartition(drawn).sortWithinPartitions(drawn)
        yield part.unionByName(marker) if page == PAGES - 1 else part


def run_stream(t, df, build, key="remote_addr", sink=jobs.start):
    """Feed ``df`` in pages to ``build`` (stream in, stream out) and read the sink; also gives the queries."""
    base, queries = workdir(t), []
    out = f"{base}/out"
    for part in pages(t, df, key):
        part.write.mode("append").parquet(f"{base}/in")
        stream = jobs.read_pages(t.spark, f"{base}/in", df.schema, FILES)
        q = sink(build(stream), out, f"{base}/checkpoint", poll=None)
        q.awaitTermination()
        queries.append(q)
    return t.spark.read.parquet(out), queries


def log_rows(t):
    return t.log.select("event_id", "ts", "us", "remote_addr", "request_uri", "http_user_agent", "status", "body_bytes_sent", "event_type")


def alert_rows(t):
    return t.alerts.select("event_id", "us", F.timestamp_micros("us").alias("ts"), "source_ip", "attack_type", "severity", "risk_score")


@query("src06_incremental_read", "SELECT event_id, remote_addr, status FROM log", ("log",))
def _(t):
    out, _ = run_stream(t, log_rows(t), lambda s: s.select("event_id", "remote_addr", "status"))
    return out.filter(F.col("remote_addr") != MARKER)


@query("str01_polled_alerts", "SELECT event_id, source_ip, attack_type, severity FROM alerts", ("alerts",))
def _(t):
    out, _ = run_stream(t, log_rows(t), lambda s: jobs.classified_alerts(s, WATERMARK), sink=jobs.start_alert_sink)
    return out.select("event_id", "source_ip", "attack_type", "severity")


_SLIDES = f"unnest(range((us // {DAY // 6}) * {DAY // 6} - {DAY} + {DAY // 6}, (us // {DAY // 6}) * {DAY // 6} + 1, {DAY // 6}))"


@query("str02_sliding_rate", f"SELECT remote_addr, start_us, count(*) AS requests FROM (SELECT remote_addr, {_SLIDES} AS start_us FROM log) GROUP BY 1, 2 HAVING count(*) > 6", ("log",))
def _(t):
    out, _ = run_stream(t, log_rows(t), lambda s: jobs.sliding_rate(s, "1 day", "4 hours", WATERMARK, 6))
    return out


@query(
    "str03_feature_windows",
    f"""SELECT ip AS remote_addr, bucket * {DAY} AS start_us, event_count AS requests, bytes, f8_ua_suspicion_score AS ua_suspicion, CAST(f6_unique_endpoints_per_min AS BIGINT) AS unique_endpoints,
          f3_failed_request_ratio AS failed_ratio FROM features JOIN (SELECT remote_addr AS ip, us // {DAY} AS bucket, CAST(sum(body_bytes_sent) AS BIGINT) AS bytes FROM log GROUP BY 1, 2) USING (ip, bucket)""",
    ("features",),
)
def _(t):
    out, _ = run_stream(t, log_rows(t), lambda s: jobs.feature_windows(s, "1 day", WATERMARK))
    return out.filter(F.col("remote_addr") != MARKER).drop("endpoint_entropy").withColumn("failed_ratio", F.round("failed_ratio", 6))


@query("str03_ten_features", f"SELECT ip AS remote_addr, bucket * {DAY} AS start_us, event_count, {', '.join(FEATURES)} FROM features", ("features",))
def _(t):
    rows = t.log.select("event_id", "ts", "us", "remote_addr", "request_uri", "request_method", "http_user_agent", "status", "body_bytes_sent", "request_time")
    out, _ = run_stream(t, rows, lambda s: jobs.behaviour_windows(s, "1 day", WATERMARK))
    whole = {"f1_request_frequency", "f6_unique_endpoints_per_min", "f8_ua_suspicion_score"}
    return out.filter(F.col("remote_addr") != MARKER).withColumns({f: F.round(f, 6) for f in FEATURES if f not in whole})


@query("str04_fingerprint_state", f"WITH RECURSIVE {ESTIMATES} SELECT event_id, remote_addr, round(composite + 1e-9, 6) AS composite FROM prints", ("log",))
def _(t):
    observed = detectors.event_estimates(t.log).withColumn("ts", F.timestamp_micros("us"))
    out, _ = run_stream(t, observed, lambda s: jobs.fingerprints(s, WATERMARK, keep_ms=400 * 86_400_000))
    return out.filter(F.col("remote_addr") != MARKER).withColumn("composite", F.round(F.col("composite") + 1e-9, 6))


@query("str05_suppression_state", f"WITH RECURSIVE {_SUPPRESS} SELECT event_id, source_ip, attack_type, seq >= 3 AS suppressed FROM g", ("alerts",))
def _(t):
    out, _ = run_stream(t, alert_rows(t).fillna({"attack_type": ""}), lambda s: jobs.suppression(s, WATERMARK, quiet_us=QUIET), key="source_ip")
    return out.filter(F.col("source_ip") != MARKER)


@query(
    "str06_incident_state",
    f"""WITH RECURSIVE {_fold_sql('SELECT * FROM alerts', 'source_ip', 'attack_type', 2 * DAY, True, 'event_id, source_ip, attack_type, risk_score')}
        SELECT source_ip, attack_type, anchor AS first_seen_us, max(us) AS last_seen_us, count(*) AS alert_count, max(risk_score) AS max_score FROM g GROUP BY source_ip, attack_type, anchor""",
    ("alerts",),
)
def _(t):
    out, _ = run_stream(t, alert_rows(t), lambda s: jobs.incident_stream(s, WATERMARK, span_us=2 * DAY), key="source_ip")
    return out.filter(F.col("source_ip") != MARKER)


@query(
    "str07_confirmation_state",
    f"SELECT event_id, entity_id, count(*) OVER w = 10 AND sum(y_hybrid) OVER w >= 4 AS escalated FROM judged WINDOW w AS {CONFIRM}",
    ("judged",),
)
def _(t):
    flagged = t.judged.select("event_id", "us", F.timestamp_micros("us").alias("ts"), "entity_id", F.col("y_hybrid").alias("flag"))
    out, _ = run_stream(t, flagged, lambda s: jobs.confirmations(s.fillna({"flag": 0}), WATERMARK, keep_ms=400 * 86_400_000), key="entity_id")
    return out.filter(F.col("entity_id") != MARKER)


@query("str08_new_alerts_only", "SELECT event_id, source_ip, rule FROM alerts", ("alerts",))
def _(t):
    doubled = log_rows(t)
    out, _ = run_stream(t, doubled.unionByName(doubled), lambda s: jobs.classified_alerts(s, WATERMARK))
    return out.select("event_id", "source_ip", "rule")


@query(
    "str09_stream_static_enrichment",
    "SELECT event_id, source_ip, coalesce(s_acctbal > 5000, false) AS malicious FROM alerts LEFT JOIN supplier ON source_ip = '10.' || (s_suppkey // 65536) || '.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey % 256)",
    ("alerts",),
)
def _(t):
    from tracewarden.plans.fusion_plans import intel

    listed = intel(t)
    out, _ = run_stream(t, alert_rows(t), lambda s: jobs.enriched(s, listed, "source_ip"), key="source_ip")
    return out.filter(F.col("source_ip") != MARKER).select("event_id", "source_ip", F.coalesce("malicious", F.lit(False)).alias("malicious"))


@query(
    "str10_session_windows",
    f"""SELECT remote_addr, min(us) AS first_us, max(us) AS last_us, count(*) AS requests FROM (
          SELECT *, sum(s) OVER (PARTITION BY remote_addr ORDER BY us) AS session FROM (
            SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY remote_addr ORDER BY us) <= {DAY // 2} THEN 0 ELSE 1 END AS s FROM log)) GROUP BY remote_addr, session""",
    ("log",),
)
def _(t):
    out, _ = run_stream(t, log_rows(t), lambda s: jobs.session_windows(s, "12 hours", WATERMARK))
    return out.filter(F.col("remote_addr") != MARKER)


def observed_run(t):
    """Progress rows of the sliding rate over all pages, from a listener."""
    with jobs.ProgressLog(t.spark, f"{workdir(t)}/progress") as log:
        _, queries = run_stream(t, log_rows(t), lambda s: jobs.sliding_rate(s, "1 day", "4 hours", WATERMARK, 6))
        return log.table(queries)


@query("str11_throughput_report")
def _(t):
    return jobs.throughput_report(observed_run(t))


@query("str11_processed_events", "SELECT count(*) + 1 AS events, 0 AS dropped_late FROM log", ("log",))
def _(t):
    """All rows and the closing one, whatever the pages."""
    return jobs.throughput_report(observed_run(t)).select("events", "dropped_late")


@query("str11_micro_batches", f"SELECT count(DISTINCT least((us - lo) // {PAGE_US}, {PAGES - 1})) AS busy_batches FROM log, (SELECT min(us) AS lo FROM log)", ("log",))
def _(t):
    """Micro-batches that had rows: one a page."""
    return observed_run(t).where("rows > 0").agg(F.count(F.lit(1)).alias("busy_batches"))


@query(
    "win19_idle_eviction",
    f"WITH RECURSIVE {_SUPPRESS} SELECT event_id, source_ip, attack_type, seq >= 2 AS suppressed FROM g",
    ("alerts",),
)
def _(t):
    # keys silent for longer than the quiet period leave the state; the flags must not change by it
    out, _ = run_stream(t, alert_rows(t).fillna({"attack_type": ""}), lambda s: jobs.suppression(s, WATERMARK, suppress_after=2, quiet_us=QUIET), key="source_ip")
    return out.filter(F.col("source_ip") != MARKER)


IDLE_US = 600_000_000


@query(
    "win19_held_keys",
    f"""SELECT source_ip, attack_type, max(us) // 1000 + {IDLE_US // 1000 + 1} > (SELECT max(us) FROM alerts) // 1000 - {DELAY_DAYS * DAY // 1000} AS held_before, false AS held_after
        FROM (SELECT source_ip, coalesce(attack_type, '') AS attack_type, us FROM alerts) GROUP BY 1, 2""",
    ("alerts",),
)
def _(t):
    """Keys in the state when the input pauses, and when the watermark has passed ten silent minutes more."""
    base, held = workdir(t), {}
    # requests are classified once; the pages, the newest time and the keys are read from the table of alerts
    alert_rows(t).fillna({"attack_type": ""}).write.parquet(f"{base}/alerts")
    df = t.spark.read.parquet(f"{base}/alerts")

    def feed(part, name):
        part.write.mode("append").parquet(f"{base}/in")
        build = jobs.suppression(jobs.read_pages(t.spark, f"{base}/in", df.schema, FILES), WATERMARK, quiet_us=IDLE_US)
        jobs.start(build, f"{base}/out", f"{base}/checkpoint", poll=None).awaitTermination()
        if name:
            held[name] = cut_lineage(jobs.held_keys(t.spark, f"{base}/checkpoint").filter(F.col("source_ip") != MARKER).withColumn(name, F.lit(True)))

    for page, part in enumerate(pages(t, df, "source_ip")):
        feed(part.filter(F.col("source_ip") != MARKER), "held_before" if page == PAGES - 1 else None)
    late = F.timestamp_micros(df.agg(F.max("us") + (DELAY_DAYS * DAY + IDLE_US + 1_000_000)).scalar())
    values = {"source_ip": F.lit(MARKER), "ts": late, "us": F.unix_micros(late), "event_id": F.lit(-1)}
    feed(t.spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]).fillna({"attack_type": ""}), "held_after")
    keys = ["source_ip", "attack_type"]
    found = df.select(*keys).distinct().join(held["held_before"], keys, "left").join(held["held_after"], keys, "left")
    return found.select(*keys, *[F.coalesce(c, F.lit(False)).alias(c) for c in held])
