"""Fuse model, behaviour and rule signals into scores, levels and traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import calibration as C
from tracewarden.functions.maths import ratio


def component_scores(df: DataFrame, shift: float = 0.0, strength: Column | float = 0.9) -> DataFrame:
    """Add ``p_ml``, ``p_behavior`` and ``p_rule`` from ``ml_raw``, ``z`` and ``rule_triggered``."""
    return df.withColumns(
        {
            "p_ml": C.sigmoid(F.col("ml_raw")),
            "p_behavior": C.tail_probability(F.col("z") - F.lit(shift)),
            "p_rule": C.rule_confidence(F.col("rule_triggered"), strength),
        }
    )


def weighted_score(w_ml, w_rule, w_behavior) -> Column:
    as_col = lambda w: w if isinstance(w, Column) else F.lit(w)
    return as_col(w_ml) * F.col("p_ml") + as_col(w_rule) * F.col("p_rule") + as_col(w_behavior) * F.col("p_behavior")


def adaptive_hybrid(events: DataFrame, *, size: int = 10, needed: int = 4, strength: Column | float = 0.9) -> DataFrame:
    """Drift-weighted score per event, raised by a quarter while the entity's anomaly is confirmed.

    Input: ``entity_id, us, event_id, ml_raw, z, rule_triggered, drift``.  The trace keeps inputs and
    contributions; the explanation is the same in words.
    """
    from tracewarden.operators.detectors import confirm

    df = component_scores(events, strength=strength).withColumn("w", C.regime_weights(F.col("drift")))
    df = df.withColumn("_base", weighted_score(F.col("w.w_ml"), F.col("w.w_rule"), F.col("w.w_behavior")))
    df = confirm(df, F.col("_base") >= 0.40, size=size, needed=needed)
    final = F.when(F.col("escalated"), F.least(F.lit(1.0), F.col("_base") * 1.25)).otherwise(F.col("_base"))
    df = df.withColumn("_final", final).withColumn("alert_level", C.alert_level(F.col("_final")))
    trace = F.struct(
        F.col("ml_raw").alias("raw_ml"),
        F.col("z").alias("raw_z"),
        "rule_triggered",
        (F.col("w.w_ml") * F.col("p_ml")).alias("ml_contribution"),
        (F.col("w.w_rule") * F.col("p_rule")).alias("rule_contribution"),
        (F.col("w.w_behavior") * F.col("p_behavior")).alias("behavior_contribution"),
        F.lit("weighted_sum").alias("fusion_logic"),
    )
    explanation = F.format_string(
        "ML(p=%.3f×w=%.2f) + Rule(p=%.3f×w=%.2f) + Behavior(p=%.3f×w=%.2f) → %.3f [%s] | drift_regime=%s | escalated=%s",
        "p_ml", "w.w_ml", "p_rule", "w.w_rule", "p_behavior", "w.w_behavior", "_final", F.upper("alert_level"), "w.regime",
        F.col("escalated").cast("string"),
    )
    return df.select(
        *[c for c in events.columns],
        F.round("_final", 4).alias("final_score"),
        "alert_level",
        F.col("w.regime").alias("drift_regime"),
        "escalated",
        trace.alias("trace"),
        explanation.alias("explanation"),
    )


def profile_scores(events: DataFrame, profiles: Sequence[str] | None = None) -> DataFrame:
    """Score every event under named profiles; alerting rows carry level medium or high.

    The few profiles are expanded inside the row, so nothing is joined.
    """
    chosen = [p for p in C.FUSION_PROFILES if profiles is None or p[0] in profiles]
    df = component_scores(events, shift=1.5)
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("profile"), weighted_score(ml, rule, beh).alias("score"), F.lit(alert).alias("alert_at"), F.lit(esc).alias("escalate_at"))
            for name, ml, rule, beh, alert, esc, _, _ in chosen
        ]
    )
    out = df.select(*events.columns, F.explode(cells).alias("c")).select(*events.columns, "c.*")
    alerting = F.col("score") >= F.col("alert_at")
    level = F.when(alerting, F.when(F.col("score") >= F.col("escalate_at"), "high").otherwise("medium")).otherwise("none")
    return out.withColumns({"alerting": alerting, "alert_level": level})


def profile_stream(events: DataFrame, profile: str, *, category: str = "category", quiet_us: int = 300_000_000, span_us: int = 120_000_000) -> tuple[DataFrame, DataFrame]:
    """Alerts of one profile after suppression, and the incidents they form."""
    from tracewarden.operators.detectors import incidents, suppress

    scored = profile_scores(events, [profile]).filter("alerting")
    order = ["us", "event_id"]
    kept = suppress(
        scored.select("event_id", "us", "entity_id", category, "score", "alert_level"), keys=["entity_id", category], order=order, quiet_us=quiet_us
    ).filter("not suppressed")
    kept = kept.drop("anchor_us", "group_seq", "suppressed")
    grouped = incidents(
        kept, entity="entity_id", category=category, order=order, score="score", level_rank=C.level_rank(F.col("alert_level")), names=C.LEVEL_ORDER, span_us=span_us
    )
    return kept, grouped


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale a column to [0, 1] by its own range; a constant column stays unchanged."""
    span = df.agg(F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))).scalar()
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    return df.withColumn("_span", span).withColumn(
        out, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(F.col(column).cast("double"))
    ).drop("_span")


def context_score(frequency: Column, mean: float = 2.1, std: float = 0.7) -> Column:
    """Deviation of a request frequency from the baseline, six sigma being 1."""
    if std == 0:
        return F.lit(0.0)
    return F.least(F.greatest((frequency - mean) / std / 6.0, F.lit(0.0)), F.lit(1.0))


def three_way(df: DataFrame, rule: str, ml: str, context: str, *, weights=(0.5, 0.3, 0.2), threshold: float = 0.7) -> DataFrame:
    scaled = min_max(df, ml, "ml_norm")
    risk = weights[0] * F.col(rule) + weights[1] * F.col("ml_norm") + weights[2] * F.col(context)
    return scaled.withColumn("risk", risk).withColumn("predicted", (F.col("risk") > threshold).cast("int"))


def weight_grid() -> list[tuple[float, float, float]]:
    """Rule .3 to .7 and model .1 to .5 in steps of .1; context is the rest, between 0 and .5."""
    grid = []
    for r in range(3, 8):
        for m in range(1, 6):
            c = round(1.0 - r / 10 - m / 10, 2)
            if 0 <= c <= 0.5:
                grid.append((r / 10, m / 10, c))
    return grid


def tune_weights(df: DataFrame, label: str, rule: str, ml_norm: str, context: str, threshold: float = 0.7) -> DataFrame:
    """F1 of every weight combination, best first; all combinations are counted in one pass."""
    grid = weight_grid()
    y = F.col(label) == 1

    def cell(i: int) -> Column:
        r, m, c = grid[i]
        hit = r * F.col(rule) + m * F.col(ml_norm) + c * F.col(context) > threshold
        return F.struct(
            F.lit(r).alias("w_rule"), F.lit(m).alias("w_ml"), F.lit(c).alias("w_context"),
            F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"),
        )

    counted = df.agg(F.array(*[cell(i) for i in range(len(grid))]).alias("g")).select(F.explode("g").alias("g")).select("g.*")
    f1 = ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counted.withColumn("f1", f1).orderBy(F.desc("f1"), "w_rule", "w_ml")


# Weights (ml, rule, behaviour) of the ablation scorers.
ABLATIONS: Mapping[str, tuple[float, float, float]] = {
    "Rule Only": (0.0, 1.0, 0.0),
    "ML Only": (1.0, 0.0, 0.0),
    "Behavioral Only": (0.0, 0.0, 1.0),
    "Hybrid (Full)": (0.35, 0.35, 0.30),
    "Hybrid (-ML)": (0.0, 0.50, 0.50),
    "Hybrid (-Rules)": (0.55, 0.0, 0.45),
    "Hybrid (-Behavioral)": (0.50, 0.50, 0.0),
}


def ablation_scores(df: DataFrame, ml: str, rule: str, behavior: str, keep: Sequence[str]) -> DataFrame:
    """Long form: one row per event and scorer."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("scorer"), (a * F.col(ml) + b * F.col(rule) + c * F.col(behavior)).alias("score"))
            for name, (a, b, c) in ABLATIONS.items()
        ]
    )
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def intel_adjusted(df: DataFrame, score: str, threat: str, ip: str) -> DataFrame:
    """Raise alerts whose address is known malicious, lower those of clean external addresses."""
    from tracewarden.functions.signatures import is_internal

    bad = F.coalesce(F.col("malicious"), F.lit(False))
    clean = F.col("malicious").isNotNull() & ~bad & (F.col("confidence") == 0) & ~is_internal(F.col(ip))
    return df.withColumns(
        {
            "adjusted_score": F.when(bad, F.least(F.col(score) + 0.3, F.lit(0.99)))
            .when(clean, F.greatest(F.col(score) - 0.3, F.lit(0.1)))
            .otherwise(F.col(score)),
            "threat_type": F.when(bad, F.concat(F.col(threat), F.lit(" + Intel Match"))).otherwise(F.col(threat)),
        }
    )


def intel_boost(score: Column, confidence: Column) -> Column:
    return F.least(score + confidence / 100, F.lit(1.0))


def two_term_risk(rule: Column, ml: Column) -> Column:
    """Rule and model scores on a 0-100 scale."""
    return rule * 0.6 + ml * 0.4


def degraded(rule: Column, ml: Column, context: Column) -> Column:
    """``struct(mode, score)`` from whichever inputs are present."""
    full = F.struct(F.lit("full").alias("mode"), (0.5 * rule + 0.3 * ml + 0.2 * context).alias("score"))
    part = F.struct(F.lit("degraded").alias("mode"), (0.7 * rule + 0.3 * ml).alias("score"))
    only = F.struct(F.lit("minimal").alias("mode"), rule.cast("double").alias("score"))
    none = F.struct(F.lit("passthrough").alias("mode"), F.lit(None).cast("double").alias("score"))
    return (
        F.when(rule.isNull(), none)
        .when(ml.isNull(), only)
        .when(context.isNull(), part)
        .otherwise(full)
    )


def component_flags(df: DataFrame) -> DataFrame:
    """Which components alone would have fired."""
    p = component_scores(df, shift=1.5)
    hybrid = weighted_score(0.35, 0.35, 0.30)
    return p.withColumns(
        {
            "ml_flag": F.col("ml_raw") >= 0.55,
            "behavior_flag": F.col("z") >= 2.5,
            "rule_flag": F.col("rule_triggered"),
            "hybrid_flag": hybrid >= 0.45,
        }
    )


def top_contributors(contributions: Column, k: int = 5) -> Column:
    """The ``k`` largest positive contributions of an array of (feature, value)."""
    from tracewarden.operators.cleanup import by_magnitude

    return F.slice(by_magnitude(F.filter(contributions, lambda x: x["value"] > 0)), 1, k)
