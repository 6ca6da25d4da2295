"""Distribution statistics and drift: PSI, Kolmogorov, rank and effect-size tests, correlation, gates.

All tests of a feature table run together in long form (feature, value).  Order statistics come from value
counts and ``prefix_sums``; a feature is never gathered or sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.maths import kolmogorov_tail, ratio, student_two_sided, two_sided
from tracewarden.operators.folds import ema_before
from tracewarden.operators.scale import prefix_sums, ranked_quantiles
from tracewarden.session import cut_lineage

PSI_EPS = 1e-6
KL_EPS = 1e-10


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def two_sample_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows ``feature, value, n_expected, n_actual`` from two long tables."""
    both = expected.withColumn("e", F.lit(1)).unionByName(actual.withColumn("e", F.lit(0)))
    return both.groupBy("feature", "value").agg(F.sum("e").alias("n_expected"), F.sum(1 - F.col("e")).alias("n_actual"))


def ranked_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``two_sample_counts`` with running counts ``ce``, ``ca`` and totals ``ne``, ``na``: all that the tests need."""
    counts = two_sample_counts(expected, actual)
    run = prefix_sums(counts, ["feature"], ["value"], {"ce": F.col("n_expected"), "ca": F.col("n_actual")}, totals=True)
    return cut_lineage(run.withColumnsRenamed({"ce_total": "ne", "ca_total": "na"}))


def per_feature(df: DataFrame, value: str) -> Column:
    """A small value of every feature as one scalar map, so that no large side is joined on a few names."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct("feature", value)))).scalar()


def psi(expected: DataFrame, actual: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability per feature over the deduplicated quantile bins of ``expected``.

    Values outside the expected range are ignored, the last bin is closed, fewer than three edges give 0.
    Edges are compared exactly: between equal values interpolation gives that very value.
    """
    return ranked_psi(ranked_counts(expected, actual), bins)


def ranked_psi(ranked: DataFrame, bins: int = 10) -> DataFrame:
    quantiles = ranked_quantiles(ranked, ["feature"], "value", [i / bins for i in range(bins + 1)], "n_expected", "ce", "ne")
    # at most bins + 1 numbers per feature
    edges = cut_lineage(quantiles.groupBy("feature").agg(F.sort_array(F.collect_set("quantile")).alias("edges")))
    last = F.element_at("edges", -1)
    placed = (
        ranked.select("feature", "value", "n_expected", "n_actual")
        .withColumn("edges", F.element_at(per_feature(edges, "edges"), F.col("feature")))
        .filter((F.size("edges") >= 3) & F.col("value").between(F.element_at("edges", 1), last))
        .withColumn("bin", F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, F.size("edges") - 2))
    )
    filled = placed.groupBy("feature", "bin").agg(F.sum("n_expected").alias("e"), F.sum("n_actual").alias("a"))
    grid = edges.filter(F.size("edges") >= 3).select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    whole = Window.partitionBy("feature")  # a row for each bin
    cells = grid.join(filled, ["feature", "bin"], "left").withColumns({"te": F.sum("e").over(whole), "ta": F.sum("a").over(whole)})
    share = lambda n, total: F.greatest(F.coalesce(n, F.lit(0)) / (total + PSI_EPS), F.lit(PSI_EPS))
    pe, pa = share(F.col("e"), F.col("te")), share(F.col("a"), F.col("ta"))
    found = cells.groupBy("feature").agg(F.round(F.sum((pa - pe) * F.log(pa / pe)), 4).alias("psi"))
    return edges.select("feature").join(found, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def kolmogorov(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Two-sample statistic per feature with the asymptotic p-value."""
    return ranked_kolmogorov(ranked_counts(expected, actual))


def ranked_kolmogorov(ranked: DataFrame) -> DataFrame:
    gap = F.abs(F.col("ce") / F.col("ne") - F.col("ca") / F.col("na"))
    out = ranked.groupBy("feature").agg(F.max(gap).alias("ks_stat"), F.max("ne").alias("ne"), F.max("na").alias("na"))
    effective = F.sqrt(F.col("ne") * F.col("na") / (F.col("ne") + F.col("na")))
    return out.select("feature", "ks_stat", kolmogorov_tail(effective * F.col("ks_stat")).alias("ks_p"))


def drift_report(expected: DataFrame, actual: DataFrame, *, warn: float = 0.1, drift: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """One row per feature, largest PSI first; both tests read the same ranked value counts."""
    p, ks = F.col("psi"), F.col("ks_p") < alpha
    ranked = ranked_counts(expected, actual)
    joined = ranked_psi(ranked).join(ranked_kolmogorov(ranked), "feature")
    return joined.select(
        "feature",
        "psi",
        F.when(p < warn, "STABLE").when(p < drift, "WARNING").otherwise("DRIFT").alias("psi_status"),
        F.round("ks_stat", 4).alias("ks_stat"),
        "ks_p",
        ks.alias("ks_drift"),
        F.when((p > drift) | ks, "DRIFT_DETECTED").when(p > warn, "WARNING").otherwise("STABLE").alias("status"),
    ).orderBy(F.desc("psi"), "feature")


def retrain_decision(report: DataFrame, *, psi_above: float = 0.2, features: int = 2) -> DataFrame:
    row = report.agg((F.count_if(F.col("psi") > psi_above) >= features).alias("by_psi"), F.coalesce(F.bool_or("ks_drift"), F.lit(False)).alias("by_ks"))
    any_ = F.col("by_psi") | F.col("by_ks")
    reasons = F.array_compact(
        F.array(F.when(F.col("by_psi"), f"PSI > {psi_above:.2f} on {features}+ features"), F.when(F.col("by_ks"), "KS-test drift detected"))
    )
    return row.select(
        any_.alias("should_retrain"), reasons.alias("triggers"), F.when(any_, "Immediate retraining").otherwise("Continue monitoring").alias("recommended_action")
    )


def promotion(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Promote unless F1 drops by .01 or the false-alarm rate grows by more than .005; roll back above 5 %."""
    row = candidate.select(F.col("f1").alias("new_f1"), F.col("fpr").alias("new_fpr")).withColumn("_c", current.select(F.struct("f1", "fpr")).scalar())
    return row.select(
        "new_f1",
        "new_fpr",
        ((F.col("new_f1") > F.col("_c.f1") - 0.01) & (F.col("new_fpr") <= F.col("_c.fpr") + 0.005)).alias("promote"),
        (F.col("new_fpr") > 0.05).alias("roll_back"),
    )


def class_moments(samples: DataFrame, label: str = "label") -> DataFrame:
    """Per feature: count, mean and sample variance of both classes (0 normal, 1 attack)."""
    aggs = []
    for name, y in (("n", 0), ("a", 1)):
        v = F.when(F.col(label) == y, F.col("value"))
        aggs += [F.count(v).alias(f"{name}_count"), F.avg(v).alias(f"{name}_mean"), F.var_samp(v).alias(f"{name}_var")]
    return samples.groupBy("feature").agg(*aggs)


def welch(moments: DataFrame, large_samples: bool = False) -> DataFrame:
    """t statistic and two-sided p with the Welch-Satterthwaite degrees of freedom.

    ``large_samples`` takes the normal tail instead, which is too small at ten rows a class.
    """
    vn, va = F.col("n_var") / F.col("n_count"), F.col("a_var") / F.col("a_count")
    se = F.sqrt(vn + va)
    t = F.when(se > 0, (F.col("n_mean") - F.col("a_mean")) / se)
    df = F.when(se > 0, (vn + va) * (vn + va) / (vn * vn / (F.col("n_count") - 1) + va * va / (F.col("a_count") - 1)))
    found = moments.withColumns({"t_stat": t, "freedom": df})
    return found.withColumn("p_ttest", two_sided(F.col("t_stat")) if large_samples else student_two_sided(F.col("t_stat"), F.col("freedom")))


def effect_size(moments: DataFrame) -> DataFrame:
    pooled = F.sqrt((F.col("n_var") + F.col("a_var")) / 2)
    d = F.when(pooled > 0, (F.col("a_mean") - F.col("n_mean")) / pooled).otherwise(0.0)
    size = F.abs(F.col("cohens_d"))
    label = F.when(size >= 2.0, "very large").when(size >= 0.8, "large").when(size >= 0.5, "medium").otherwise("small")
    return moments.withColumn("cohens_d", d).withColumn("effect_size", label).withColumn("recommended", F.abs("cohens_d") >= 0.5)


def class_counts(samples: DataFrame, label: str = "label") -> DataFrame:
    """Value counts of both classes with their running total ``upto``."""
    counts = samples.groupBy("feature", "value").agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("a"))
    return prefix_sums(counts, ["feature"], ["value"], {"upto": F.col("n") + F.col("a")})


def mann_whitney(samples: DataFrame, label: str = "label") -> DataFrame:
    """U of the normal class, two-sided p with tie and continuity correction, from value counts."""
    return ranked_mann_whitney(class_counts(samples, label))


def ranked_mann_whitney(run: DataFrame) -> DataFrame:
    ties = F.col("n") + F.col("a")
    rank = F.col("upto") - ties + (ties + 1) / 2
    t = ties.cast("double")
    s = run.groupBy("feature").agg(
        F.sum(F.col("n") * rank).alias("rank_sum"), F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum(t * t * t - t).alias("ties")
    )
    n, a = F.col("n").cast("double"), F.col("a").cast("double")
    total = n + a
    u = F.col("rank_sum") - n * (n + 1) / 2
    spread = F.sqrt(n * a / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    z = (F.greatest(u, n * a - u) - n * a / 2 - 0.5) / spread
    return s.select("feature", u.alias("u_stat"), F.when(spread > 0, F.least(F.lit(1.0), 2.0 * _upper(z))).otherwise(1.0).alias("p_mw"))


def _upper(z: Column) -> Column:
    from tracewarden.functions.maths import normal_tail

    return normal_tail(z)


def kl_divergence(samples: DataFrame, label: str = "label", bins: int = 50) -> DataFrame:
    """KL(attack || normal) over equal-width bins shared by both classes."""
    counts = samples.groupBy("feature", "value").agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("a"))
    return counted_divergence(counts, bins)


def counted_divergence(counts: DataFrame, bins: int = 50) -> DataFrame:
    """``kl_divergence`` from the value counts ``n`` and ``a`` of both classes."""
    low, high = F.min("value"), F.max("value") + 1e-9
    span = cut_lineage(
        counts.groupBy("feature").agg(F.struct(low.alias("lo"), ((high - low) / bins).alias("width"), F.sum("n").alias("tn"), F.sum("a").alias("ta")).alias("s"))
    )
    own = F.element_at(per_feature(span, "s"), F.col("feature"))
    at = F.least(F.floor((F.col("value") - F.col("s.lo")) / F.col("s.width")), F.lit(bins - 1))
    filled = counts.select("feature", "value", "n", "a", own.alias("s")).groupBy("feature", at.alias("bin")).agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    grid = span.select("feature", "s.*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    density = lambda c, total: F.coalesce(c, F.lit(0)) / (total * F.col("width")) + KL_EPS
    cells = grid.join(filled, ["feature", "bin"], "left").select("feature", density(F.col("n"), F.col("tn")).alias("dn"), density(F.col("a"), F.col("ta")).alias("da"))
    # with p = da / sum(da) and q = dn / sum(dn) the sum of p ln(p / q) needs three sums only
    sums = cells.groupBy("feature").agg(
        F.sum("da").alias("sa"), F.sum("dn").alias("sn"), F.sum(F.col("da") * F.log(F.col("da") / F.col("dn"))).alias("x")
    )
    return sums.select("feature", (F.col("x") / F.col("sa") - F.log(F.col("sa") / F.col("sn"))).alias("kl_divergence"))


def discrimination_report(samples: DataFrame, label: str = "label", min_rows: int = 10) -> DataFrame:
    """How well each feature separates the classes, strongest first; small classes are skipped."""
    m = effect_size(welch(class_moments(samples, label))).filter((F.col("n_count") >= min_rows) & (F.col("a_count") >= min_rows))
    run = cut_lineage(class_counts(samples, label))
    joined = m.join(ranked_mann_whitney(run), "feature").join(counted_divergence(run), "feature")
    return joined.select(
        "feature", "n_mean", "a_mean", (F.col("a_mean") - F.col("n_mean")).alias("mean_delta"), F.sqrt("n_var").alias("n_std"), F.sqrt("a_var").alias("a_std"),
        "p_ttest", "p_mw", "cohens_d", "effect_size", "kl_divergence", (F.col("p_mw") < 0.05).alias("significant"), "recommended",
    ).orderBy(F.desc(F.abs("cohens_d")), "feature")


def correlations(df: DataFrame, features: Sequence[str], redundant_above: float = 0.8) -> DataFrame:
    """Pearson r of every feature pair, all pairs in one aggregation pass."""
    pairs = list(combinations(features, 2))
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*").withColumn("redundant", F.coalesce(F.abs("r") > redundant_above, F.lit(False)))


def mean_shift(training: DataFrame, current: DataFrame) -> DataFrame:
    """z of each feature's current mean against its training mean and deviation."""
    base = training.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    now = current.groupBy("feature").agg(F.avg("value").alias("now"))
    return base.join(now, "feature").select("feature", ratio(F.col("now") - F.col("mean"), F.col("std")).alias("z"))


def tracked_false_alarms(daily: DataFrame, key: str, day: str, rate: str, *, base: float, alpha: float = 0.1) -> DataFrame:
    """Threshold of every rule moved by the smoothed false-alarm rate of the days before."""
    df = ema_before(daily, [key], [day], {rate: 0.0}, alpha)
    return df.withColumn("adjusted_threshold", F.lit(base) * (1 + F.col(f"{rate}_before")))
