"""Log clean-up, field fallbacks and the filters, searches and orderings over alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.sources.schemas import FIELD_ALIASES, FLOW_DEFAULTS

# Internal health checks that never reach the detectors.
INTERNAL_PATHS = ("/health", "/nginx-status")


def status_class(status: Column) -> Column:
    return (
        F.when(status >= 500, "5xx").when(status >= 400, "4xx").when(status >= 300, "3xx").when(status >= 200, "2xx")
    )


def shipped_log(df: DataFrame) -> DataFrame:
    """Drop internal requests, cast sizes leniently (bad text becomes null), add ``status_class``."""
    casts = {c: F.col(c).try_cast("int") for c in ("status", "body_bytes_sent", "request_length") if c in df.columns}
    kept = df.filter(F.col("request_uri").isNull() | ~F.col("request_uri").isin(*INTERNAL_PATHS))
    return kept.withColumns(casts).withColumn("status_class", status_class(F.col("status")))


def fill_missing(df: DataFrame, defaults: Mapping[str, object] = FLOW_DEFAULTS) -> DataFrame:
    """Add absent columns with their default; present columns stay as they are."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def prepared_log(df: DataFrame) -> DataFrame:
    """Raw frame to analysis frame: UTC time (unparsable rows dropped), numbers, fills, derived columns."""
    status = F.col("status").try_cast("double")
    return (
        df.withColumn("timestamp", F.try_to_timestamp("timestamp"))
        .filter(F.col("timestamp").isNotNull())
        .withColumns(
            {
                "status": status,
                "body_bytes_sent": F.col("body_bytes_sent").try_cast("double"),
                "request_time": F.col("request_time").try_cast("double"),
                "remote_addr": F.coalesce("remote_addr", F.lit("unknown")),
                "request_uri": F.coalesce("request_uri", F.lit("/")),
                "http_user_agent": F.coalesce("http_user_agent", F.lit("-")),
            }
        )
    )


def time_and_error_columns(df: DataFrame, time: str = "timestamp") -> DataFrame:
    known = F.coalesce(F.col("status"), F.lit(0))
    return df.withColumns(
        {
            "minute": F.date_trunc("minute", time),
            "hour": F.date_trunc("hour", time),
            "is_4xx": known.between(400, 499),
            "is_5xx": known.between(500, 599),
            "is_error": known >= 400,
        }
    )


def with_aliases(df: DataFrame, aliases=FIELD_ALIASES) -> DataFrame:
    """Resolve every field from the names present, then the default; missing names cost nothing."""
    out = {}
    for field, (names, default) in aliases.items():
        present = [F.col(f"`{n}`") for n in names if n in df.columns]
        if present or default is not None:
            tail = [] if default is None else [F.lit(default)]
            out[field] = F.coalesce(*present, *tail)
    return df.withColumns(out)


def alert_records(df: DataFrame) -> DataFrame:
    """Classify requests and project the firing ones to alert rows."""
    hit = S.classify_request(F.col("request_uri"), F.col("http_user_agent"), F.col("status"))
    return (
        S.keep_hits(df, hit, "_hit")
        .select(
            "alert_id",
            "event_id",
            "us",
            F.col("remote_addr").alias("source_ip"),
            F.col("_hit.attack_type").alias("attack_type"),
            F.col("_hit.severity").alias("severity"),
            F.lit("ACTIVE").alias("status"),
            F.col("_hit.rule").alias("rule"),
            F.col("_hit.risk").alias("risk_score"),
            F.round(F.col("_hit.risk") * 0.9 + 0.05, 3).alias("ml_score"),
            F.concat("_hit.attack_type", F.lit(" from "), "remote_addr", F.lit(" → "), F.substring("request_uri", 1, 80)).alias("message"),
            "request_uri",
        )
    )


def latest(df: DataFrame, us: str, width_us: int, limit: int, columns: Sequence[str], tie: str) -> DataFrame:
    """Newest rows of the last ``width_us`` before the newest event, at most ``limit`` (a top-k report)."""
    newest = df.agg(F.max(us)).scalar()
    return df.filter(F.col(us) >= newest - F.lit(width_us)).orderBy(F.desc(us), F.desc(tie)).limit(limit).select(*columns)


def severity_is(df: DataFrame, severity: str | None) -> DataFrame:
    return df if severity is None else df.filter(F.upper("severity") == F.upper(F.lit(severity)))


def search_alerts(df: DataFrame, text: str, severity: str = "ALL") -> DataFrame:
    found = F.col("source_ip").contains(text) | F.lower("attack_type").contains(text.lower())
    return df.filter(found if severity == "ALL" else found & (F.col("severity") == severity))


def select_alerts(df: DataFrame, severities: Sequence[str], types: Sequence[str]) -> DataFrame:
    return df.filter(F.col("severity").isin(*severities) & F.col("attack_type").isin(*types))


def search_hosts(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).contains(text)
    return df.filter(found)


def by_magnitude(contributions: Column) -> Column:
    """Contribution structs (name, value), largest absolute value first, ties by name."""

    def order(a: Column, b: Column) -> Column:
        left, right = F.abs(a["value"]), F.abs(b["value"])
        return (
            F.when(left > right, -1).when(left < right, 1)
            .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
        )

    return F.array_sort(contributions, order)
