"""Counters, tiles, histograms and monitoring conditions over alerts and traffic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.maths import ratio
from tracewarden.operators.features import bucket_of
from tracewarden.operators.scale import exact_quantiles

# Severity levels always shown, and histogram bounds in seconds.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
RULE_LATENCY_BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1)
MODEL_LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per severity, the five known levels zero-filled, unknown levels kept, with the total."""
    levels = alerts.sparkSession.createDataFrame([(s, 0) for s in SEVERITIES], "severity string, n long")
    counted = alerts.groupBy(F.upper("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    filled = levels.unionByName(counted).groupBy("severity").agg(F.sum("n").alias("n"))
    # the frame spans one row per severity level
    return filled.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def severity_tiles(alerts: DataFrame, critical: Sequence[str] = ("CRITICAL",), warning: Sequence[str] = ("HIGH", "MEDIUM")) -> DataFrame:
    s = F.upper("severity")
    return alerts.agg(
        F.count_if(s.isin(*critical)).alias("critical"), F.count_if(s.isin(*warning)).alias("warning"), F.count(F.lit(1)).alias("total")
    )


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values (a top-k report), ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def traffic_histogram(log: DataFrame, width_us: int, buckets: int) -> DataFrame:
    """The last ``buckets`` windows up to the newest event, empty ones kept."""
    newest = log.agg(F.max(bucket_of(F.col("us"), width_us))).scalar()
    counted = (
        log.withColumn("bucket", bucket_of(F.col("us"), width_us))
        .filter(F.col("bucket") > newest - F.lit(buckets))
        .groupBy("bucket")
        .agg(F.sum("body_bytes_sent").alias("inbound"), F.count(F.lit(1)).alias("requests"))
    )
    grid = log.sparkSession.range(1).select(F.explode(F.sequence(newest - F.lit(buckets - 1), newest)).alias("bucket"))
    zero = F.lit(0).cast("bigint")
    return grid.join(counted, "bucket", "left").select(
        "bucket",
        F.coalesce("inbound", zero).alias("inbound"),
        F.floor(F.coalesce("inbound", zero) * 0.4).alias("outbound"),
        F.floor(F.coalesce("requests", zero) / 10).alias("threats"),
    )


def active_sources(alerts: DataFrame, width_us: int) -> DataFrame:
    """Distinct alerting sources in the window before the newest alert."""
    newest = alerts.agg(F.max("us")).scalar()
    recent = alerts.filter(F.col("us") > newest - F.lit(width_us))
    return recent.agg(F.count_distinct("source_ip").alias("active_sources"))


def counters(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def cumulative_histogram(df: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Rows with ``value`` up to each bound, in one pass, as ``labels, le, n``; the last bound is infinite."""
    counted = df.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)], F.count(value).alias("_all")
    )
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return counted.select(*labels, F.explode(F.array(*cells)).alias("c")).select(*labels, "c.le", "c.n")


def sustained(series: DataFrame, flag: Column, hold: int, time: str = "bucket") -> DataFrame:
    """``firing`` when ``flag`` held in every window of the last ``hold`` + 1 (all present).

    Every flagged window votes for itself and the next ``hold`` windows; no ordering of the series is needed.
    """
    flagged = series.withColumn("flag", F.coalesce(flag, F.lit(False)))
    shifts = flagged.filter("flag").select(F.explode(F.sequence(F.col(time), F.col(time) + hold)).alias(time))
    held = shifts.groupBy(time).agg(F.count(F.lit(1)).alias("_held"))
    return (
        flagged.join(held, time, "left")
        .withColumn("firing", F.coalesce(F.col("_held") == hold + 1, F.lit(False)))
        .drop("_held")
    )


def rate_series(log: DataFrame, width_us: int, conditions: Mapping[str, Column]) -> DataFrame:
    """Share of events meeting each condition per window."""
    return log.groupBy(bucket_of(F.col("us"), width_us).alias("bucket")).agg(
        *[ratio(F.count_if(c), F.count(F.lit(1))).alias(n) for n, c in conditions.items()]
    )


def psi_series(log: DataFrame, value: Column, baseline: Column, width_us: int, bins: int = 10) -> DataFrame:
    """Population stability of a value per window after the baseline period, over the quantile bins of that period.

    Values beyond the baseline's range are ignored and fewer than three edges give no rows, as in ``drift.psi``.
    """
    from tracewarden.operators.drift import PSI_EPS

    rows = log.select(bucket_of(F.col("us"), width_us).alias("bucket"), value.cast("double").alias("value"), baseline.alias("early"))
    quantiles = exact_quantiles(rows.filter("early"), [], "value", [i / bins for i in range(bins + 1)])
    edges = quantiles.agg(F.sort_array(F.collect_set("quantile"))).scalar()
    placed = rows.withColumn("edges", edges).filter((F.size("edges") >= 3) & F.col("value").between(F.element_at("edges", 1), F.element_at("edges", -1)))
    at = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, F.size("edges") - 2)
    # one row for each window and bin from here on
    counts = placed.groupBy("bucket", at.alias("bin"), "early").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("edges")).alias("size"))
    expected = counts.filter("early").groupBy("bin").agg(F.sum("n").alias("e"))
    of_bin = expected.agg(F.map_from_entries(F.collect_list(F.struct("bin", "e")))).scalar()
    total = expected.agg(F.sum("e")).scalar()
    actual = counts.filter("not early").groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("seen"), F.sum("n").alias("ta"), F.max("size").alias("size"))
    cells = actual.select("bucket", "seen", "ta", F.explode(F.sequence(F.lit(0), F.col("size") - 2)).alias("bin"))
    share = lambda n, whole: F.greatest(F.coalesce(n, F.lit(0)) / (whole + PSI_EPS), F.lit(PSI_EPS))
    cells = cells.select("bucket", share(F.try_element_at("seen", F.col("bin")), F.col("ta")).alias("pa"), share(F.try_element_at(of_bin, F.col("bin")), total).alias("pe"))
    return cells.groupBy("bucket").agg(F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))).alias("psi"))


def ingest_lag(df: DataFrame, event_us: str, processed_us: str, labels: Sequence[str] = ()) -> DataFrame:
    lag = (F.col(processed_us) - F.col(event_us)) / 1e6
    return df.groupBy(*labels).agg(
        F.max(event_us).alias("last_event_us"), F.max(lag).alias("max_lag_seconds"), F.avg(lag).alias("mean_lag_seconds")
    )


def traffic_summary(log: DataFrame, last: int = 200) -> DataFrame:
    """Totals, rate, per-status counts and response times of the newest ``last`` requests."""
    totals = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isNull()).alias("errors"),
        ((F.max("us") - F.min("us")) / 1e6).alias("elapsed_seconds"),
    )
    newest = log.orderBy(F.desc("us"), F.desc("event_id")).limit(last).select("request_time")
    codes = log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    listing = codes.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")).scalar()
    p95 = exact_quantiles(newest, [], "request_time", [0.95]).select("quantile").scalar()
    return totals.withColumns(
        {
            "rate": ratio(F.col("total"), F.col("elapsed_seconds")),
            "status_counts": listing,
            "mean_last": newest.agg(F.avg("request_time")).scalar(),
            "p95_last": p95,
        }
    )


def slot_pivot(alerts: DataFrame, slot_us: int, types: Sequence[str]) -> DataFrame:
    """Attack counts per time slot of the day, one column per type."""
    slot = F.floor((F.col("us") % F.lit(86_400_000_000)) / F.lit(slot_us))
    return alerts.groupBy(slot.alias("slot")).agg(
        *[F.count_if(F.col("attack_type") == t).alias(t.lower().replace(" ", "_")) for t in types]
    )


def source_profiles(alerts: DataFrame) -> DataFrame:
    """Per source: alerts, highest risk, most frequent type (ties by name) and last time seen."""
    per_type = alerts.groupBy("source_ip", "attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("risk_score").alias("risk"), F.max("us").alias("last_us")
    )
    return per_type.groupBy("source_ip").agg(
        F.sum("n").alias("alerts"),
        F.max("risk").alias("risk"),
        F.min_by("attack_type", F.struct((-F.col("n")).alias("a"), F.col("attack_type").alias("b"))).alias("main_type"),
        F.max("last_us").alias("last_us"),
    )


def tally(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(column) == v).alias(v.lower()) for v in values], F.count(F.lit(1)).alias("total"))
