"""Windowed entity features.

Every aggregate is decomposed into counts and sums that combine before the shuffle; distributions
(paths, methods, characters, domains) are counted per value first, so a hot entity contributes one row
per distinct value, not per event.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions import signatures as S
from tracewarden.functions.maths import entropy_term, ratio

# What the features assume while no baseline has been learned.
BASELINE_DEFAULTS = {
    "mean_req_per_min": 2.1,
    "std_req_per_min": 0.7,
    "p99_req_per_min": 4.0,
    "threshold_req_per_min": 6.1,
    "mean_body_bytes": 1024.0,
    "std_body_bytes": 512.0,
}
FEATURES = (
    "f1_request_frequency",
    "f2_endpoint_entropy",
    "f3_failed_request_ratio",
    "f4_uri_char_entropy",
    "f5_timing_variance",
    "f6_unique_endpoints_per_min",
    "f7_http_method_gini",
    "f8_ua_suspicion_score",
    "f9_session_length",
    "f10_payload_size_zscore",
)


def bucket_of(us: Column, width_us: int) -> Column:
    """Window number; events without a usable time fall into window 0."""
    return F.coalesce(F.floor(us / F.lit(width_us)), F.lit(0).cast("bigint"))


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, name: str = "value", weight: Column | None = None) -> DataFrame:
    return df.groupBy(*keys, value.alias(name)).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))


def distribution(counts: DataFrame, keys: Sequence[str], guard: float, prefix: str) -> DataFrame:
    """Distinct values, entropy in bits and Gini impurity per key, from value counts.

    The entropy guard sits inside the logarithm, so every value's share is needed.  Values with equal counts
    have equal shares: a key first shrinks to one row per *distinct count*, at most about the square root of
    twice its events, and only those rows meet the key's total.  A hot key is thus spread over its values
    until little of it is left.
    """
    alike = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(*keys)
    share = F.col("n") / F.col("_total")
    return (
        alike.withColumn("_total", F.sum(F.col("n") * F.col("_m")).over(whole))
        .groupBy(*keys)
        .agg(
            F.sum("_m").alias(f"{prefix}_distinct"),
            F.sum(F.col("_m") * entropy_term(share, guard)).alias(f"{prefix}_entropy"),
            (1.0 - F.sum(F.col("_m") * share * share)).alias(f"{prefix}_gini"),
        )
    )


#: Neighbouring characters whose counts share a row.
BLOCK = 16


def summed(terms: Sequence[Column]) -> Column:
    return reduce(add, terms)


def letter_blocks(df: DataFrame, text: str) -> DataFrame:
    """Append ``letters``: the counts of the characters of ``text``, as the blocks of code points that occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(text).to_pylist()]
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
            spots, at = np.unique(owner * 0x110000 + codes // BLOCK * BLOCK, return_inverse=True)
            n = np.bincount(at * BLOCK + codes % BLOCK, minlength=len(spots) * BLOCK)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(spots) + 1, dtype=np.int32) * BLOCK), pa.array(n, pa.int64()))
            blocks = pa.StructArray.from_arrays([pa.array(spots % 0x110000, pa.int32()), counts], ["first", "counts"])
            begin = np.searchsorted(spots, np.arange(len(texts) + 1) * 0x110000).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(begin), blocks)], [*b.schema.names, "letters"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL("letters array<struct<first: int, counts: array<bigint>>>").fields]))


def letter_entropy(df: DataFrame, keys: Sequence[str], text: str, guard: float) -> DataFrame:
    """Entropy in bits of the characters of ``text`` per key, as ``char_entropy``; keys without characters are absent.

    Characters are counted in their task and go by blocks of ``BLOCK`` neighbours, a column each: even a hot key shrinks to
    a row a block before its rows meet.
    """
    places = [f"_n{i}" for i in range(BLOCK)]
    found = letter_blocks(df.select(*keys, text), text).select(*keys, F.explode("letters").alias("_x"))
    blocks = found.groupBy(*keys, F.col("_x.first").alias("_first")).agg(*[F.sum(F.col("_x.counts")[i]).alias(c) for i, c in enumerate(places)])
    total = F.sum(summed([F.col(c) for c in places])).over(Window.partitionBy(*keys))
    terms = summed([F.coalesce(entropy_term(F.col(c) / F.col("_total"), guard), F.lit(0.0)) for c in places])
    return blocks.withColumn("_total", total).groupBy(*keys).agg(F.sum(terms).alias("char_entropy"))


def flow_windows(flows: DataFrame, width_us: int, entity: str = "src_ip", us: str = "us") -> DataFrame:
    """Flow features per entity and tumbling window."""
    b = flows.withColumn("bucket", bucket_of(F.col(us), width_us))
    keys = [entity, "bucket"]
    base = b.groupBy(*keys).agg(
        F.sum("bytes_in").alias("bytes_in_sum"),
        F.sum("bytes_out").alias("bytes_out_sum"),
        F.count(F.lit(1)).alias("conn_count"),
        F.count_distinct("dst_port").alias("dst_port_nunique"),
        F.avg("is_nxdomain").alias("is_nxdomain_mean"),
        F.sum("failed_login").alias("failed_login_sum"),
        F.sum("fortiguard_hit").alias("fortiguard_hit_sum"),
        F.max("cvss_score").alias("cvss_score_max"),
        F.sum("is_vuln").alias("is_vuln_sum"),
    )
    domains = distribution(value_counts(b, keys, F.col("domain"), "domain"), keys, 1e-9, "domain").select(
        *keys, F.col("domain_distinct").alias("domain_nunique"), "domain_entropy"
    )
    return base.join(domains, keys)


def fill_gaps(windows: DataFrame, entity: str, zeros: Sequence[str], keep_null: Sequence[str] = ()) -> DataFrame:
    """Every window between an entity's first and last; sums and counts of empty ones are 0, means stay null.

    Window 0 holds the events without a usable time: it is kept, but it does not stretch the time line.
    """
    timed = F.when(F.col("bucket") != 0, F.col("bucket"))
    span = windows.groupBy(entity).agg(F.min(timed).alias("_a"), F.max(timed).alias("_b"), F.max(F.col("bucket") == 0).alias("_zero"))
    none = F.array().cast("array<bigint>")
    line = F.when(F.col("_a").isNotNull(), F.sequence("_a", "_b")).otherwise(none)
    at_zero = F.when(F.col("_zero"), F.array(F.lit(0).cast("long"))).otherwise(none)
    grid = span.select(entity, F.explode(F.array_union(at_zero, line)).alias("bucket"))
    return grid.join(windows, [entity, "bucket"], "left").select(
        entity, "bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zeros], *keep_null
    )


def window_deltas(windows: DataFrame, entity: str, columns: dict[str, str]) -> DataFrame:
    """Change against the previous window of the entity, 0 for the first.

    One row per entity and window comes in, so a partition is bounded by the length of the time line.
    """
    w = Window.partitionBy(entity).orderBy("bucket")
    return windows.withColumns({new: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)) for c, new in columns.items()})


def behaviour_features(
    log: DataFrame,
    width_us: int,
    *,
    window_minutes: float = 1.0,
    body_mean: Column | float = BASELINE_DEFAULTS["mean_body_bytes"],
    body_std: Column | float = BASELINE_DEFAULTS["std_body_bytes"],
    approximate: bool = False,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """The ten behavioural features per address and window.

    ``approximate`` replaces the exact distinct path count by a sketch.  ``extra`` adds aggregates of the
    same window, for example a label.
    """
    mean = body_mean if isinstance(body_mean, Column) else F.lit(body_mean)
    std = body_std if isinstance(body_std, Column) else F.lit(body_std)
    b = log.withColumn("bucket", bucket_of(F.col("us"), width_us)).withColumnRenamed("remote_addr", "ip")
    keys = ["ip", "bucket"]
    # null fields count as their usual default, as an absent field of the event would
    path = S.uri_path(F.coalesce("request_uri", F.lit("/")))
    base = b.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(F.when(F.coalesce("status", F.lit(200)) >= 400, 1.0).otherwise(0.0)).alias("_failed"),
        F.stddev_pop(F.coalesce("request_time", F.lit(0.0))).alias("_spread"),
        F.max(S.agent_suspicion(F.col("http_user_agent"))).alias("f8_ua_suspicion_score"),
        ((F.max("us") - F.min("us")) / 1e6).alias("_length"),
        F.avg(F.coalesce("body_bytes_sent", F.lit(0))).alias("_body"),
        *([F.approx_count_distinct(path).alias("_paths_approx")] if approximate else []),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    # paths and methods are counted together, characters by blocks
    token = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    pair = F.explode(F.array(token("path", path), token("method", F.coalesce("request_method", F.lit("GET")))))
    counted = b.select(*keys, pair.alias("t")).groupBy(*keys, F.col("t.kind").alias("kind"), "t.value").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    shapes = distribution(counted, [*keys, "kind"], 1e-12, "v").groupBy(*keys).agg(
        of("path", "v_distinct").alias("path_distinct"), of("path", "v_entropy").alias("path_entropy"), of("method", "v_gini").alias("method_gini")
    )
    chars = letter_entropy(b.select(*keys, F.coalesce("request_uri", F.lit("/")).alias("uri")), keys, "uri", 1e-12)
    n = F.col("event_count")
    entropy_scale = F.when(F.col("path_distinct") > 1, F.log2("path_distinct")).otherwise(1.0)
    distinct_paths = F.col("_paths_approx") if approximate else F.col("path_distinct")
    return (
        base.join(shapes, keys)
        .join(chars, keys, "left")
        .select(
            *keys,
            "event_count",
            *(extra or {}),
            (n / F.lit(window_minutes)).alias("f1_request_frequency"),
            F.when(n < 2, 0.0).otherwise(F.col("path_entropy") / entropy_scale).alias("f2_endpoint_entropy"),
            F.col("_failed").alias("f3_failed_request_ratio"),
            F.coalesce("char_entropy", F.lit(0.0)).alias("f4_uri_char_entropy"),
            F.when(n < 2, 0.0).otherwise(F.col("_spread")).alias("f5_timing_variance"),
            (distinct_paths / F.lit(window_minutes)).alias("f6_unique_endpoints_per_min"),
            F.col("method_gini").alias("f7_http_method_gini"),
            "f8_ua_suspicion_score",
            F.coalesce("_length", F.lit(0.0)).alias("f9_session_length"),
            F.when(std == 0, 0.0).otherwise(F.abs(F.col("_body") - mean) / std).alias("f10_payload_size_zscore"),
        )
    )


def feature_array(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Feature columns as one array in fixed order; absent or null features are 0."""
    cells = [F.coalesce(F.col(c), F.lit(0.0)).cast("double") if c in df.columns else F.lit(0.0) for c in columns]
    return df.withColumn("features", F.array(*cells))


def sessions(log: DataFrame, key: str, us: str, gap_us: int, sums: dict[str, Column]) -> DataFrame:
    """Sessions per key separated by more than ``gap_us`` of silence, with the given aggregates summed.

    Events within one cell of width ``gap_us`` always share a session, so sessions are built from cell
    rows: a hot key shrinks to one row per cell before it is ordered.
    """
    cells = log.groupBy(key, F.floor(F.col(us) / F.lit(gap_us)).alias("_cell")).agg(
        F.min(us).alias("_first"), F.max(us).alias("_last"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    w = Window.partitionBy(key).orderBy("_cell")
    starts = F.when(F.col("_first") - F.lag("_last").over(w) <= F.lit(gap_us), 0).otherwise(1)
    numbered = cells.withColumn("_s", starts).withColumn("session", F.sum("_s").over(w))
    return numbered.groupBy(key, "session").agg(
        F.min("_first").alias("start_us"), F.max("_last").alias("end_us"), F.sum("_n").alias("requests"), *[F.sum(n).alias(n) for n in sums]
    )


def window_extras(log: DataFrame, width_us: int, burst_us: int = 1_000_000, last_us: int = 10_000_000) -> DataFrame:
    """Per address and window: bytes per request, burst, path depth, auth-failure share, agent entropy.

    The burst is the busiest second (``burst_us``) of the window's last ten (``last_us``), 0 if they are empty.
    """
    b = log.withColumn("bucket", bucket_of(F.col("us"), width_us)).withColumnRenamed("remote_addr", "ip")
    keys = ["ip", "bucket"]
    depth = F.size(F.split(S.uri_path(F.col("request_uri")), "/")) - 1
    base = b.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("body_bytes_sent").alias("byte_ratio"),
        F.avg(depth).alias("path_depth"),
        ratio(F.count_if(F.col("status").isin(401, 403) & S.is_auth_endpoint(F.col("request_uri"))), F.count(F.lit(1))).alias("auth_failure_rate"),
    )
    late = F.col("us") >= (F.col("bucket") + 1) * width_us - last_us
    seconds = b.filter(late).groupBy(*keys, F.floor(F.col("us") / F.lit(burst_us)).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    burst = seconds.groupBy(*keys).agg(F.max("_n").alias("connection_burst"))
    agents = distribution(value_counts(b, keys, F.coalesce("http_user_agent", F.lit(""))), keys, 1e-12, "ua").select(*keys, "ua_entropy")
    return base.join(burst, keys, "left").join(agents, keys).withColumn("connection_burst", F.coalesce("connection_burst", F.lit(0)))


def rolling_deviation(windows: DataFrame, key: str, value: str, back: int) -> DataFrame:
    """z of a window against the entity's previous ``back`` windows (present ones), 0 without spread."""
    w = Window.partitionBy(key).orderBy("bucket").rangeBetween(-back, -1)
    mean, std = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return windows.withColumn("baseline_deviation", F.when(std > 0, (F.col(value) - mean) / std).otherwise(0.0))
