"""Score calibration, drift-aware weights and level bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.functions.maths import normal_tail

# Fusion weights (ml, rule, behaviour) by drift regime.
REGIME_WEIGHTS = {
    "stable": (0.25, 0.45, 0.30),
    "moderate": (0.35, 0.35, 0.30),
    "high_drift": (0.55, 0.20, 0.25),
}
# Lowest score of each alert level, best first.
LEVEL_FLOORS = (("critical", 0.85), ("high", 0.65), ("medium", 0.40), ("low", 0.20))
LEVEL_ORDER = ("none", "low", "medium", "high", "critical")
# Name, ml, rule, behaviour weights, alert floor, escalation floor, window, hits.
FUSION_PROFILES = (
    ("conservative", 0.25, 0.50, 0.25, 0.55, 0.80, 15, 6),
    ("aggressive", 0.50, 0.25, 0.25, 0.30, 0.60, 5, 2),
    ("drift-sensitive", 0.50, 0.15, 0.35, 0.40, 0.70, 10, 4),
    ("balanced", 0.35, 0.35, 0.30, 0.45, 0.70, 10, 4),
)


def sigmoid(raw: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-raw))


def tail_probability(z: Column, tail: str = "upper") -> Column:
    """``upper`` falls as z grows, which is what the fused score uses; ``lower`` is its complement."""
    p = normal_tail(z)
    return p if tail == "upper" else 1.0 - p


def rule_confidence(triggered: Column, strength: Column | float = 0.9) -> Column:
    strength = strength if isinstance(strength, Column) else F.lit(strength)
    return F.when(triggered, strength).otherwise(0.0)


def drift_regime(drift: Column, low: float = 0.3, high: float = 0.65) -> Column:
    return F.when(drift >= high, "high_drift").when(drift >= low, "moderate").otherwise("stable")


def regime_weights(drift: Column, low: float = 0.3, high: float = 0.65) -> Column:
    def weights(name: str) -> Column:
        ml, rule, behaviour = REGIME_WEIGHTS[name]
        return F.struct(
            F.lit(name).alias("regime"),
            F.lit(ml).alias("w_ml"),
            F.lit(rule).alias("w_rule"),
            F.lit(behaviour).alias("w_behavior"),
        )

    return (
        F.when(drift >= high, weights("high_drift"))
        .when(drift >= low, weights("moderate"))
        .otherwise(weights("stable"))
    )


def alert_level(score: Column) -> Column:
    chain = None
    for level, floor in LEVEL_FLOORS:
        chain = F.when(score >= floor, level) if chain is None else chain.when(score >= floor, level)
    return chain.otherwise("none")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVEL_ORDER]), level) - 1


def three_band(score: Column, high: float, medium: float, names: tuple[str, str, str]) -> Column:
    return F.when(score >= high, names[0]).when(score >= medium, names[1]).otherwise(names[2])


def profile_columns(name: str) -> dict[str, float | int | str]:
    """One named fusion profile."""
    fields = ("profile", "w_ml", "w_rule", "w_behavior", "alert_at", "escalate_at", "window", "hits")
    for row in FUSION_PROFILES:
        if row[0] == name.lower():
            return dict(zip(fields, row, strict=True))
    raise KeyError(name)
