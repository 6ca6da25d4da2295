"""Event tables as the access logs, flows, scored events and alerts the operators work on.

These views are pure projections of the given tables, so everything built on them grows with the
tables and stays one scan with pruned columns.  One minute of traffic corresponds to one day here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.session import prepare

SECOND = 1_000_000
DAY = 86_400 * SECOND

# Request texts of the attack rows, chosen by the counter of the event.
SQLI_REQUESTS = (
    "/search?q=1 UNION SELECT name FROM users--",
    "/item?id=1' OR '1'='1",
    "/q?x=1; DROP TABLE users;--",
    "/q?x=%27 OR 1=1",
    "/q?x=1 and sleep(5)",
)
TRAVERSAL_REQUESTS = (
    "/static/../../etc/passwd",
    "/get?f=%2e%2e%2fboot.ini",
    "/get?f=..\\win.ini",
    "/.%2e/../proc/self/environ",
    "/get?f=%252e%252e/x%00",
)
SCRIPT_REQUESTS = ("/c?t=<script>alert(1)</script>", "/c?t=<img a src=x onerror=alert(1)>")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def log(self) -> DataFrame:
        """Access log: one row per event."""
        e = self.read("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        k, user = F.col("k"), F.col("user_id")
        error = F.col("event_type") == "error"
        pick = lambda texts: F.element_at(F.array(*[F.lit(x) for x in texts]), (F.floor(k / 20) % len(texts) + 1).cast("int"))
        uri = (
            F.when(error & (k % 5).isin(0, 1), "/login")
            .when(k % 20 == 7, pick(SQLI_REQUESTS))
            .when(k % 20 == 13, pick(TRAVERSAL_REQUESTS))
            .when(k % 20 == 17, pick(SCRIPT_REQUESTS))
            .when(k % 20 == 19, "/.env")
            .otherwise(F.concat(F.lit("/"), "event_type", F.lit("/"), (k % 12).cast("string"), F.lit("?id="), F.col("event_id").cast("string")))
        )
        status = (
            F.when(error, F.element_at(F.array(*[F.lit(c) for c in (401, 403, 404, 500, 503)]), k % 5 + 1))
            .when(F.col("event_type") == "signup", 201)
            .when((F.col("event_type") == "click") & (k % 10 == 0), 301)
            .otherwise(200)
        )
        method = (
            F.when(F.col("event_type").isin("signup", "purchase"), "POST")
            .when(error & (k % 5 == 2), "PUT")
            .when(error & (k % 5 == 3), "OPTIONS")
            .otherwise("GET")
        )
        agent = (
            F.when(user % 10 == 0, "sqlmap/1.7")
            .when(user % 10 == 1, "curl/8.0")
            .when(user % 10 == 2, "Go-http-client/1.1")
            .when(user % 10 == 3, "-")
            .otherwise("Mozilla/5.0 Chrome/120.0")
        )
        octet = lambda c: F.floor(c).cast("string")
        return e.select(
            "event_id", "user_id", "event_type", "value", "k",
            F.col("ts").cast("timestamp").alias("ts"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            F.concat(F.lit("10."), octet(user / 65536), F.lit("."), octet((user / 256) % 256), F.lit("."), octet(user % 256)).alias("remote_addr"),
            method.alias("request_method"),
            uri.alias("request_uri"),
            status.alias("status"),
            F.floor(F.col("value") * 20).cast("long").alias("body_bytes_sent"),
            (F.col("value") / 1000).alias("request_time"),
            agent.alias("http_user_agent"),
            F.lit("-").alias("http_referer"),
            (error | (k % 20).isin(7, 13, 17, 19)).alias("is_attack"),
        )

    @cached_property
    def flows(self) -> DataFrame:
        """Flow and DNS events."""
        k = F.col("k")
        return self.log.select(
            "event_id", "us", "ts",
            F.col("remote_addr").alias("src_ip"),
            F.concat(F.lit("172.16."), (k % 4).cast("string"), F.lit("."), (k % 25).cast("string")).alias("dst_ip"),
            (F.lit(1000) + k % 7).alias("dst_port"),
            F.concat("event_type", (k % 12).cast("string"), F.lit(".example")).alias("domain"),
            "body_bytes_sent",
            F.col("body_bytes_sent").alias("bytes_in"),
            F.floor(F.col("value") * 3).cast("long").alias("bytes_out"),
            F.when(k % 9 == 0, 1).otherwise(0).alias("is_nxdomain"),
            F.when(F.col("status").isin(401, 403), 1).otherwise(0).alias("failed_login"),
            F.when(k % 20 == 7, 1).otherwise(0).alias("fortiguard_hit"),
            ((k % 11) * 0.5).alias("cvss_score"),
            F.when(k % 13 == 0, 1).otherwise(0).alias("is_vuln"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Events with raw model, behaviour and rule signals."""
        hit = S.classify_request(F.col("request_uri"), F.col("http_user_agent"), F.col("status"))
        return self.log.select(
            "event_id", "us",
            F.col("remote_addr").alias("entity_id"),
            (F.col("value") / 50 - 1).alias("ml_raw"),
            ((F.col("value") - 50) / 50).alias("z"),
            hit.isNotNull().alias("rule_triggered"),
            ((F.col("user_id") % 10) / 10).alias("drift"),
            F.col("event_type").alias("category"),
            "is_attack",
            "user_id",
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts of the request classifier."""
        from tracewarden.operators.cleanup import alert_records

        return alert_records(self.log.withColumn("alert_id", F.concat(F.lit("a"), F.col("event_id").cast("string"))))

    @cached_property
    def judged(self) -> DataFrame:
        """Labelled scores: truth, three component scores and the flags of three detectors."""
        from tracewarden.operators.fusion import component_scores

        s = component_scores(self.scored, shift=1.5)
        fused = F.round(0.35 * F.col("p_ml") + 0.35 * F.col("p_rule") + 0.30 * F.col("p_behavior"), 4)
        y_rules = F.when(F.col("rule_triggered"), 1).otherwise(0)
        return s.select(
            "event_id", "us", "entity_id", "user_id", "category", "rule_triggered", "z", "ml_raw",
            F.col("is_attack").cast("int").alias("y_true"),
            F.round("p_ml", 4).alias("ml_score"),
            F.col("p_rule").alias("rule_score"),
            F.round("p_behavior", 4).alias("behavior_score"),
            fused.alias("score"),
            y_rules.alias("y_rules"),
            F.when(F.round("p_ml", 4) >= 0.5, 1).otherwise(0).alias("y_ml"),
            F.when(fused >= 0.45, 1).otherwise(0).alias("y_hybrid"),
        )
