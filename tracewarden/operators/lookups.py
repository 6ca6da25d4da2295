"""Enrichment joins, status overlays, block list upkeep and set operations.

Joins carry no broadcast hints: Spark broadcasts a side by its own size statistics or measured size
and shuffles it otherwise, so a lookup table may grow without changing the code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Technique id, attack type, covered flag.
TECHNIQUES = (
    ("T1046", "Port Scan", 1),
    ("T1110", "Brute Force", 1),
    ("T1190", "SQL Injection", 1),
    ("T1190", "Path Traversal", 1),
    ("T1499", "DoS Flood", 1),
    ("T1071", "C2", 0),
    ("T1059", "Command", 0),
)


def technique_coverage(alerts: DataFrame) -> DataFrame:
    """Alerts per technique (zero kept) and the share of techniques covered."""
    dim = alerts.sparkSession.createDataFrame(list(TECHNIQUES), "technique string, attack_type string, covered int")
    counted = alerts.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    share = dim.agg(
        (F.count_distinct(F.when(F.col("covered") == 1, F.col("technique"))) / F.count_distinct("technique")).alias("share")
    ).scalar()
    per = dim.join(counted, "attack_type", "left").groupBy("technique")
    return per.agg(F.max("covered").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("alerts")).withColumn("coverage", share)


def normalised_intel(reports: DataFrame, malicious_above: Mapping[str, float] | None = None, otherwise: float = 50) -> DataFrame:
    """Vendor reports to one record per address, the highest raw score winning.

    A record is malicious above the threshold of its source; sources not named have ``otherwise``.
    """
    best = reports.groupBy("ip").agg(F.max_by(F.struct("source", "raw_score", "confidence", "tags"), F.struct("raw_score", "source")).alias("r"))
    above = F.lit(float(otherwise))
    for source, score in (malicious_above or {}).items():
        above = F.when(F.col("source") == source, float(score)).otherwise(above)
    return best.select("ip", "r.*").withColumn("malicious", F.col("raw_score") > above)


def enrich(df: DataFrame, intel: DataFrame, ip: str) -> DataFrame:
    """Left join by address; unknown addresses keep null intel."""
    return df.join(intel.withColumnRenamed("ip", ip), ip, "left")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key: an aggregate, so versions of a hot key are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def overlay_status(alerts: DataFrame, changes: DataFrame, default: str = "ACTIVE") -> DataFrame:
    """Current status of every alert; changes are many per alert and the latest counts."""
    now = latest_per_key(changes, ["alert_id"], ["updated_us", "status"]).select("alert_id", F.col("status").alias("_now"))
    return alerts.join(now, "alert_id", "left").withColumn("status", F.coalesce("_now", F.lit(default))).drop("_now")


def upsert_status(current: DataFrame, updates: DataFrame) -> DataFrame:
    return latest_per_key(current.unionByName(updates), ["alert_id"], ["updated_us", "status"])


def newest_first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order])


def add_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert only the keys not listed yet; the first of several new rows for one key wins."""
    fresh = new.join(existing.select(key), key, "left_anti")
    rest = [c for c in new.columns if c != key]
    first = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    return existing.unionByName(first)


def remove_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def flag_by_source(events: DataFrame, detections: DataFrame, source: str) -> DataFrame:
    """Every event of a detected source is flagged."""
    hit = detections.select(source).distinct().withColumn("_hit", F.lit(True))
    return events.join(hit, source, "left").withColumn("flagged", F.coalesce("_hit", F.lit(False))).drop("_hit")


def with_thresholds(events: DataFrame, profile: DataFrame, names: Sequence[str]) -> DataFrame:
    """Attach values of a one-row profile as scalar subqueries: no join at all."""
    return events.withColumns({n: profile.select(n).scalar() for n in names})


def embedding_or_zero(ids: DataFrame, vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), width)
    return ids.join(vectors.select(key, vector), key, "left").withColumn(vector, F.coalesce(F.col(vector), zero))


def concat_encodings(parts: Sequence[DataFrame], key: str, vectors: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """Align encodings by key and concatenate them; a wrong width fails the job."""
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.join(p, key)
    whole: Column = F.concat(*[F.col(v).cast("array<double>") for v in vectors])
    return joined.select(
        key,
        F.when(F.size(whole) == sum(widths), whole)
        .otherwise(F.raise_error(F.lit("unexpected encoding width")).cast("array<double>"))
        .alias("encoding"),
    )
