"""Learn what normal traffic looks like: frequency, endpoint, status and agent profiles.

Each profile is a one-row table; they are combined through scalar subqueries, never cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.functions.maths import kolmogorov_tail, ratio
from tracewarden.operators.features import bucket_of


def requests_per_bucket(log: DataFrame, width_us: int) -> DataFrame:
    """Requests per address and window: the observations the rate profile is learned from."""
    return log.groupBy(F.col("remote_addr").alias("ip"), bucket_of(F.col("us"), width_us).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def frequency_thresholds(observations: DataFrame) -> DataFrame:
    """Moments, percentiles and rate thresholds, as one row."""
    probs = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    # exact percentiles keep one entry for each distinct count, and combine before the shuffle
    row = observations.agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("std"),
        F.skewness("n").alias("skewness"),
        F.kurtosis("n").alias("kurtosis"),
        F.percentile("n", F.array(*[F.lit(p) for p in probs.values()])).alias("_q"),
    )
    row = row.withColumns({name: F.get("_q", F.lit(k)) for k, name in enumerate(probs)}).drop("_q")
    return row.withColumn("median", F.col("p50")).withColumns(
        {
            "threshold": F.col("p99") + 3 * F.col("std"),
            "threshold_conservative": F.col("p99") + 2 * F.col("std"),
            "threshold_aggressive": F.col("p95") + 3 * F.col("std"),
        }
    )


def request_frequency(observations: DataFrame) -> DataFrame:
    """``frequency_thresholds`` plus the distance of the counts to a Poisson law."""
    ks = poisson_distance(observations.groupBy("n").agg(F.count(F.lit(1)).alias("weight")))
    row = frequency_thresholds(observations).withColumn("ks_stat", ks.select("ks_stat").scalar())
    p = kolmogorov_tail(F.sqrt("observations") * F.col("ks_stat"))
    return row.withColumns({"ks_p": p, "fits_poisson": p > 0.05})


def poisson_distance(counts: DataFrame) -> DataFrame:
    """Kolmogorov distance between counts and Poisson(mean), from rows ``n, weight``.

    ``counts`` has one row per distinct requests-per-window value.  The law is accumulated inside the row over as
    many terms as the spread of the law has, so the comparison needs no join; the empirical side is a running share
    over the distinct values.
    """
    from tracewarden.operators.scale import prefix_sums

    ranked = prefix_sums(counts, [], ["n"], {"_cum": F.col("weight"), "_events": F.col("n") * F.col("weight")}, totals=True)
    ranked = ranked.withColumnRenamed("_cum_total", "_total").withColumn("_lam", F.col("_events_total") / F.col("_total"))
    # Terms are taken relative to the one at the mean and followed both ways until they are below 1e-300 of it, so
    # one law holds for any mean; their sum makes up for the missing factor.
    lam, n = F.col("_lam"), F.col("n")
    centre = F.floor(lam)
    reach = F.ceil(40 * F.sqrt(lam) + 400).cast("long")

    def follow(indices, factor):
        start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("all"), F.lit(0.0).alias("upto"))

        def add(acc, i):
            term = acc["term"] * factor(i)
            upto = acc["upto"] + F.when(index(i) <= n, term).otherwise(0.0)
            return F.struct(term.alias("term"), (acc["all"] + term).alias("all"), upto.alias("upto"))

        index = (lambda i: i) if indices is ahead else (lambda i: i - 1)
        return F.aggregate(indices, start, add)

    none = F.array().cast("array<bigint>")
    ahead = F.sequence(centre + 1, centre + reach)
    back = F.when(centre >= 1, F.sequence(centre, F.greatest(centre - reach, F.lit(0)) + 1, F.lit(-1).cast("long"))).otherwise(none)
    up = follow(ahead, lambda i: lam / i)
    down = follow(back, lambda i: i / lam)
    middle = F.when(centre <= n, 1.0).otherwise(0.0)
    upto = (up["upto"] + down["upto"] + middle) / (up["all"] + down["all"] + 1.0)
    # the distance is taken on both sides of every observed value, against the law at that value
    above = F.col("_cum") / F.col("_total") - upto
    below = upto - (F.col("_cum") - F.col("weight")) / F.col("_total")
    return ranked.agg(F.max(F.greatest(above, below)).alias("ks_stat"))


def endpoint_distribution(log: DataFrame, top: int = 10) -> DataFrame:
    """Distinct URIs, their entropy and the most requested ones, as one row."""
    counts = log.groupBy("request_uri").agg(F.count(F.lit(1)).alias("n"))
    # -sum(p log2 p) with p = n / N is log2 N - sum(n log2 n) / N: one pass, no second total
    total = F.sum("n")
    summary = counts.agg(
        F.count(F.lit(1)).alias("unique_uris"), (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy_bits")
    )
    best = counts.orderBy(F.desc("n"), "request_uri").limit(top)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "request_uri", "n")))
    names = best.agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["request_uri"], x["n"])))).scalar()
    norm = ratio(F.col("entropy_bits"), F.col("entropy_max"))
    return (
        summary.withColumn("entropy_max", F.log2("unique_uris"))
        .withColumn("entropy_norm", norm)
        .withColumn("scan_threshold", F.col("entropy_norm") * 2)
        .withColumn("top_endpoints", names)
    )


def status_distribution(log: DataFrame) -> DataFrame:
    """Counts per code and error rates with their six-fold thresholds, as one row."""
    counts = log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    part = lambda cond: ratio(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.sum("n"))
    s = F.col("status")
    row = counts.agg(
        F.sum("n").alias("total_requests"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status_codes"),
        part(s >= 400).alias("error_rate"),
        part(s.between(400, 499)).alias("rate_4xx"),
        part(s.between(500, 599)).alias("rate_5xx"),
    )
    return row.withColumns(
        {
            "threshold_error_rate": F.col("error_rate") * 6,
            "threshold_4xx_rate": F.col("rate_4xx") * 6,
            "threshold_5xx_rate": F.col("rate_5xx") * 6,
        }
    )


def status_table(log: DataFrame) -> DataFrame:
    s = F.col("status")
    category = F.when(s < 300, "Success").when(s < 400, "Redirect").when(s < 500, "Client Error").otherwise("Server Error")
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("category", category)


def user_agents(log: DataFrame) -> DataFrame:
    """Agent diversity and suspicious share, as one row, from one row per distinct agent."""
    counts = log.groupBy(F.coalesce("http_user_agent", F.lit("-")).alias("agent")).agg(F.count(F.lit(1)).alias("n"))
    suspicious = F.sum(F.when(F.lower("agent").rlike(S.BASELINE_SUSPICIOUS_AGENTS), F.col("n")).otherwise(0))
    row = counts.agg(F.count(F.lit(1)).alias("unique_user_agents"), F.sum("n").alias("total"), suspicious.alias("suspicious_ua_count"))
    return row.select(
        "unique_user_agents",
        ratio(F.col("unique_user_agents"), F.col("total")).alias("diversity_ratio"),
        "suspicious_ua_count",
        ratio(F.col("suspicious_ua_count"), F.col("total")).alias("suspicious_ua_rate"),
        (ratio(F.col("unique_user_agents"), F.col("total")) * 0.1).alias("detection_threshold_diversity"),
    )


def profile(log: DataFrame, width_us: int) -> DataFrame:
    """The whole baseline as one nested row, including thresholds and their rationale."""
    freq = request_frequency(requests_per_bucket(log, width_us))
    ends, status, agents = endpoint_distribution(log), status_distribution(log), user_agents(log)
    whole = lambda df: df.select(F.struct("*")).scalar()
    meta = log.agg(
        F.count(F.lit(1)).alias("total_requests"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.count_distinct("remote_addr").alias("unique_ips"),
    )
    row = meta.select(F.struct("*").alias("metadata")).withColumns(
        {
            "request_frequency": whole(freq),
            "endpoint_distribution": whole(ends),
            "status_codes": whole(status),
            "user_agents": whole(agents),
        }
    )
    thresholds = F.struct(
        F.round("request_frequency.threshold", 4).alias("rate_limit_req_per_min"),
        F.round("request_frequency.threshold_conservative", 4).alias("rate_limit_conservative"),
        F.round("request_frequency.threshold_aggressive", 4).alias("rate_limit_aggressive"),
        F.round("status_codes.threshold_error_rate", 6).alias("error_rate_threshold"),
        F.round("status_codes.threshold_4xx_rate", 6).alias("rate_4xx_threshold"),
        F.round("status_codes.threshold_5xx_rate", 6).alias("rate_5xx_threshold"),
        F.round("endpoint_distribution.scan_threshold", 4).alias("entropy_scan_threshold"),
        F.format_string("P99(%.4f) + 3σ(%.4f)", F.col("request_frequency.p99"), 3 * F.col("request_frequency.std")).alias("rate_limit_rationale"),
        F.format_string("6x baseline error rate (%.4f)", F.col("status_codes.error_rate")).alias("error_rate_rationale"),
        F.format_string("2x baseline entropy (%.4f)", F.col("endpoint_distribution.entropy_norm")).alias("entropy_rationale"),
    )
    return row.withColumn("detection_thresholds", thresholds)


def frequency_histogram(observations: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram between the smallest and largest observation; the last bin is closed."""
    lo, hi = observations.agg(F.min("n")).scalar(), observations.agg(F.max("n")).scalar()
    counts = observations.groupBy("n").agg(F.count(F.lit(1)).alias("w")).withColumns({"_lo": lo, "_hi": hi})
    bin_no = F.least(F.floor((F.col("n") - F.col("_lo")) * bins / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))), F.lit(bins - 1))
    return counts.groupBy(bin_no.alias("bin")).agg(F.sum("w").alias("n"))
