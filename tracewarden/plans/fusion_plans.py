"""Score calibration and fusion."""

from pyspark.sql import functions as F

from tracewarden.functions import calibration as C
from tracewarden.operators import fusion
from tracewarden.plans.detector_plans import CONFIRM, _fold_sql
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import DAY, bands, regime, tail


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("fus01_sigmoid", "SELECT event_id, round(1.0 / (1.0 + exp(-ml_raw)), 6) AS p_ml FROM scored", ("scored",))
def _(t):
    return t.scored.select("event_id", F.round(C.sigmoid(F.col("ml_raw")), 6).alias("p_ml"))


@query(
    "fus02_tail_probability",
    f"SELECT event_id, round({tail('z')}, 6) AS upper_tail, round(1.0 - {tail('z')}, 6) AS lower_tail FROM scored",
    ("scored",),
)
def _(t):
    z = F.col("z")
    return t.scored.select("event_id", F.round(C.tail_probability(z), 6).alias("upper_tail"), F.round(C.tail_probability(z, "lower"), 6).alias("lower_tail"))


@query("fus03_rule_confidence", "SELECT event_id, CASE WHEN rule_triggered THEN 0.9::DOUBLE ELSE 0.0 END AS p_rule FROM scored", ("scored",))
def _(t):
    return t.scored.select("event_id", C.rule_confidence(F.col("rule_triggered")).alias("p_rule"))


@query(
    "fus04_regime_weights",
    f"SELECT event_id, {regime('drift')} AS regime, {regime('drift', 0)} AS w_ml, {regime('drift', 1)} AS w_rule, {regime('drift', 2)} AS w_behavior FROM scored",
    ("scored",),
)
def _(t):
    return t.scored.select("event_id", C.regime_weights(F.col("drift")).alias("w")).select("event_id", "w.*")


HYBRID = f"""hybrid AS (SELECT *, CASE WHEN esc THEN least(1.0, base * 1.25) ELSE base END AS final FROM (
  SELECT *, count(*) OVER w = 10 AND sum(CASE WHEN base >= 0.40 THEN 1 ELSE 0 END) OVER w >= 4 AS esc FROM (
    SELECT *, w_ml * p_ml + w_rule * p_rule + w_beh * p_beh AS base FROM (
      SELECT *, 1.0 / (1.0 + exp(-ml_raw)) AS p_ml, CASE WHEN rule_triggered THEN 0.9::DOUBLE ELSE 0.0 END AS p_rule, {tail('z')} AS p_beh,
        {regime('drift', 0)} AS w_ml, {regime('drift', 1)} AS w_rule, {regime('drift', 2)} AS w_beh, {regime('drift')} AS regime FROM scored))
  WINDOW w AS {CONFIRM}))"""


@query(
    "fus05_adaptive_hybrid",
    f"WITH {HYBRID} SELECT event_id, round(final, 4) AS final_score, {bands('final')} AS alert_level, regime AS drift_regime, esc AS escalated FROM hybrid",
    ("scored",),
)
def _(t):
    return fusion.adaptive_hybrid(t.scored).select("event_id", "final_score", "alert_level", "drift_regime", "escalated")


@query("fus06_alert_level", f"SELECT event_id, score, {bands('score')} AS alert_level FROM judged", ("judged",))
def _(t):
    return t.judged.select("event_id", "score", C.alert_level(F.col("score")).alias("alert_level"))


@query(
    "fus07_decision_trace",
    f"""WITH {HYBRID} SELECT event_id, round(w_ml * p_ml, 6) AS ml_contribution, round(w_rule * p_rule, 6) AS rule_contribution, round(w_beh * p_beh, 6) AS behavior_contribution,
          'weighted_sum' AS fusion_logic, printf('ML(p=%.3f×w=%.2f) + Rule(p=%.3f×w=%.2f) + Behavior(p=%.3f×w=%.2f) → %.3f [%s] | drift_regime=%s | escalated=%s',
            p_ml, w_ml, p_rule, w_rule, p_beh, w_beh, final, upper({bands('final')}), regime, CAST(esc AS VARCHAR)) AS explanation FROM hybrid""",
    ("scored",),
)
def _(t):
    df = fusion.adaptive_hybrid(t.scored)
    return df.select(
        "event_id", *[F.round(f"trace.{c}", 6).alias(c) for c in ("ml_contribution", "rule_contribution", "behavior_contribution")], "trace.fusion_logic", "explanation"
    )


def _profile_sql(keep="event_id, us, entity_id, category"):
    rows = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for n, a, b, c, d, e, _, _ in C.FUSION_PROFILES)
    return f"""SELECT {keep}, profile, alert_at, escalate_at, w_ml * p_ml + w_rule * p_rule + w_beh * p_beh AS score FROM (
      SELECT *, 1.0 / (1.0 + exp(-ml_raw)) AS p_ml, CASE WHEN rule_triggered THEN 0.9::DOUBLE ELSE 0.0 END AS p_rule, {tail('zs')} AS p_beh
      FROM (SELECT *, z - 1.5 AS zs FROM scored)), (VALUES {rows}) v(profile, w_ml, w_rule, w_beh, alert_at, escalate_at)"""


@query(
    "fus08_profile_scores",
    f"""SELECT event_id, profile, round(score, 6) AS score, score >= alert_at AS alerting,
          CASE WHEN score >= escalate_at AND score >= alert_at THEN 'high' WHEN score >= alert_at THEN 'medium' ELSE 'none' END AS alert_level FROM ({_profile_sql()})""",
    ("scored",),
)
def _(t):
    return fusion.profile_scores(t.scored).select("event_id", "profile", F.round("score", 6).alias("score"), "alerting", "alert_level")


_KEPT = f"""p AS (SELECT * FROM ({_profile_sql()}) WHERE profile = 'aggressive' AND score >= alert_at),
  {_fold_sql('SELECT * FROM p', 'entity_id', 'category', 5 * DAY, False, 'event_id, entity_id, category, score, escalate_at')},
  kept AS (SELECT event_id, us, entity_id, category, score, escalate_at FROM g WHERE seq < 3)"""
_INC = (
    _fold_sql("SELECT * FROM kept", "entity_id", "category", 2 * DAY, True, "event_id, entity_id, category, score, escalate_at")
    .replace("o AS (", "o2 AS (").replace("g AS (", "g2 AS (").replace("FROM o WHERE", "FROM o2 WHERE").replace("FROM g JOIN o ON", "FROM g2 g JOIN o2 o ON")
)


@query("fus09_profile_alerts", f"WITH RECURSIVE {_KEPT} SELECT event_id, round(score, 6) AS score, CASE WHEN score >= escalate_at THEN 'high' ELSE 'medium' END AS alert_level FROM kept", ("scored",))
def _(t):
    kept, _ = fusion.profile_stream(t.scored, "aggressive", quiet_us=5 * DAY, span_us=2 * DAY)
    return kept.select("event_id", F.round("score", 6).alias("score"), "alert_level")


@query(
    "fus09_profile_incidents",
    f"""WITH RECURSIVE {_KEPT}, {_INC} SELECT entity_id, category, anchor AS first_seen_us, max(us) AS last_seen_us, count(*) AS alert_count, round(max(score), 6) AS max_score,
          CASE WHEN bool_or(score >= escalate_at) THEN 'high' ELSE 'medium' END AS severity FROM g2 GROUP BY entity_id, category, anchor""",
    ("scored",),
)
def _(t):
    _, grouped = fusion.profile_stream(t.scored, "aggressive", quiet_us=5 * DAY, span_us=2 * DAY)
    return grouped.select("entity_id", "category", "first_seen_us", "last_seen_us", "alert_count", F.round("max_score", 6).alias("max_score"), "severity")


THREE = """three AS (SELECT *, round(0.5 * rule_score + 0.3 * ml_norm + 0.2 * ctx, 6) AS risk FROM (
  SELECT *, (ml_score - min(ml_score) OVER ()) / (max(ml_score) OVER () - min(ml_score) OVER ()) AS ml_norm, least(greatest(z / 6.0, 0.0), 1.0) AS ctx FROM judged))"""


def with_context(t):
    return t.judged.withColumn("ctx", F.least(F.greatest(F.col("z") / 6.0, F.lit(0.0)), F.lit(1.0)))


@query("fus10_three_way", f"WITH {THREE} SELECT event_id, risk, CAST(risk > 0.4 AS INTEGER) AS predicted FROM three", ("judged",))
def _(t):
    df = fusion.three_way(with_context(t), "rule_score", "ml_score", "ctx", threshold=0.4)
    return df.select("event_id", F.round("risk", 6).alias("risk")).withColumn("predicted", (F.col("risk") > 0.4).cast("int"))


@query(
    "fus10_context_score",
    "SELECT ip, bucket, round(least(greatest((n - 2.1) / 0.7 / 6.0, 0.0), 1.0), 6) AS context FROM (SELECT ip, bucket, CAST(n AS DOUBLE) AS n FROM daily)",
    ("daily",),
)
def _(t):
    from tracewarden.operators import baseline

    obs = baseline.requests_per_bucket(t.log, DAY)
    return obs.select("ip", "bucket", F.round(fusion.context_score(F.col("n")), 6).alias("context"))


@query(
    "fus11_weight_grid",
    f"""WITH {THREE}, grid AS (SELECT r / 10 AS w_rule, m / 10 AS w_ml, round(1.0::DOUBLE - r / 10 - m / 10, 2) AS w_context FROM range(3, 8) a(r), range(1, 6) b(m)
            WHERE round(1.0::DOUBLE - r / 10 - m / 10, 2) BETWEEN 0 AND 0.5),
        c AS (SELECT w_rule, w_ml, w_context, count(*) FILTER (WHERE hit AND y_true = 1) AS tp, count(*) FILTER (WHERE hit AND y_true = 0) AS fp, count(*) FILTER (WHERE NOT hit AND y_true = 1) AS fn
          FROM (SELECT g.*, y_true, w_rule * rule_score + w_ml * ml_norm + w_context * ctx > 0.35 AS hit FROM three, grid g) GROUP BY 1, 2, 3)
        SELECT w_rule, w_ml, w_context, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c ORDER BY f1 DESC, w_rule, w_ml""",
    ("judged",),
)
def _(t):
    df = fusion.min_max(with_context(t), "ml_score", "ml_norm")
    tuned = fusion.tune_weights(df, "y_true", "rule_score", "ml_norm", "ctx", threshold=0.35)
    return tuned.withColumn("f1", F.round("f1", 6))


@query(
    "fus12_ablation_scores",
    " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS scorer, round({a} * ml_score + {b} * rule_score + {c} * behavior_score, 6) AS score FROM judged" for n, (a, b, c) in fusion.ABLATIONS.items()
    ),
    ("judged",),
)
def _(t):
    df = fusion.ablation_scores(t.judged, "ml_score", "rule_score", "behavior_score", ["event_id"])
    return df.select("event_id", "scorer", F.round("score", 6).alias("score"))


INTEL = "intel AS (SELECT '10.' || (s_suppkey // 65536) || '.' || (s_suppkey // 256 % 256) || '.' || (s_suppkey % 256) AS ip, s_acctbal > 5000 AS malicious, CASE WHEN s_acctbal > 5000 THEN CAST(floor(s_acctbal / 100) AS BIGINT) ELSE 0 END AS confidence FROM supplier)"


def intel(t):
    bal = F.col("s_acctbal")
    return t.read("supplier").select(
        F.concat_ws(".", F.lit("10"), *[F.floor(F.col("s_suppkey") / n % 256).cast("string") for n in (65536, 256, 1)]).alias("ip"),
        (bal > 5000).alias("malicious"),
        F.when(bal > 5000, F.floor(bal / 100)).otherwise(0).alias("confidence"),
    )


_ADJUSTED = f"""{INTEL}, adj AS (SELECT alert_id, CASE WHEN malicious THEN least(risk_score + 0.3, 0.99) WHEN NOT malicious AND confidence = 0 AND NOT starts_with(ext, '10.') THEN greatest(risk_score - 0.3, 0.1) ELSE risk_score END AS s,
    CASE WHEN malicious THEN attack_type || ' + Intel Match' ELSE attack_type END AS threat_type
  FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN source_ip ELSE '172.' || source_ip END AS ext FROM alerts) LEFT JOIN intel ON ip = source_ip)"""


def adjusted(t):
    from tracewarden.operators import lookups

    seen = t.alerts.withColumn("ext", F.when(F.col("event_id") % 2 == 0, F.col("source_ip")).otherwise(F.concat(F.lit("172."), "source_ip")))
    return fusion.intel_adjusted(lookups.enrich(seen, intel(t), "source_ip"), "risk_score", "attack_type", "ext")


@query("fus13_intel_adjusted", f"WITH {_ADJUSTED} SELECT alert_id, round(s, 6) AS adjusted_score, threat_type FROM adj", ("alerts",))
def _(t):
    return adjusted(t).select("alert_id", F.round("adjusted_score", 6).alias("adjusted_score"), "threat_type")


@query("fus14_score_severity", f"WITH {_ADJUSTED} SELECT alert_id, CASE WHEN s >= 0.85 THEN 'critical' WHEN s >= 0.6 THEN 'high' ELSE 'medium' END AS severity FROM adj", ("alerts",))
def _(t):
    return adjusted(t).select("alert_id", C.three_band(F.col("adjusted_score"), 0.85, 0.60, ("critical", "high", "medium")).alias("severity"))


@query("fus15_risk_level", "SELECT event_id, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.5 THEN 'warning' ELSE 'info' END AS risk_level FROM judged", ("judged",))
def _(t):
    return t.judged.select("event_id", C.three_band(F.col("score"), 0.85, 0.5, ("critical", "warning", "info")).alias("risk_level"))


@query(
    "fus16_intel_boost",
    f"WITH {INTEL} SELECT event_id, round(CASE WHEN malicious THEN least(score + confidence / 100, 1.0) ELSE score END, 6) AS boosted FROM judged LEFT JOIN intel ON ip = entity_id",
    ("judged",),
)
def _(t):
    from tracewarden.operators import lookups

    df = lookups.enrich(t.judged, intel(t), "entity_id")
    boosted = F.when(F.col("malicious"), fusion.intel_boost(F.col("score"), F.col("confidence"))).otherwise(F.col("score"))
    return df.select("event_id", F.round(boosted, 6).alias("boosted"))


@query(
    "fus17_two_term_risk",
    "SELECT event_id, risk, CASE WHEN risk > 80 THEN 'CRITICAL' WHEN risk > 50 THEN 'WARNING' ELSE 'NONE' END AS level FROM (SELECT event_id, round(60 * rule_score + 40 * ml_score, 6) AS risk FROM judged)",
    ("judged",),
)
def _(t):
    risk = F.round(fusion.two_term_risk(F.col("rule_score") * 100, F.col("ml_score") * 100), 6)
    df = t.judged.select("event_id", risk.alias("risk"))
    return df.withColumn("level", F.when(F.col("risk") > 80, "CRITICAL").when(F.col("risk") > 50, "WARNING").otherwise("NONE"))


@query(
    "fus18_degraded_scoring",
    """SELECT event_id, CASE WHEN r IS NULL THEN 'passthrough' WHEN m IS NULL THEN 'minimal' WHEN c IS NULL THEN 'degraded' ELSE 'full' END AS mode,
         round(CASE WHEN r IS NULL THEN NULL WHEN m IS NULL THEN r WHEN c IS NULL THEN 0.7 * r + 0.3 * m ELSE 0.5 * r + 0.3 * m + 0.2 * c END, 6) AS score
       FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE rule_score END AS r, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ml_score END AS m,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE behavior_score END AS c FROM judged)""",
    ("judged",),
)
def _(t):
    gone = lambda n, c: F.when(F.col("event_id") % n != 0, F.col(c))
    d = fusion.degraded(gone(11, "rule_score"), gone(7, "ml_score"), gone(5, "behavior_score"))
    return t.judged.select("event_id", d.alias("d")).select("event_id", "d.mode", F.round("d.score", 6).alias("score"))


@query(
    "fus19_component_flags",
    "SELECT event_id, ml_raw >= 0.55 AS ml_flag, z >= 2.5 AS behavior_flag, rule_triggered AS rule_flag FROM scored",
    ("scored",),
)
def _(t):
    return fusion.component_flags(t.scored).select("event_id", "ml_flag", "behavior_flag", "rule_flag")


@query(
    "fus20_top_contributors",
    """SELECT s.event_id, coalesce(string_agg(feature, '>' ORDER BY value DESC, feature), '') AS contributors FROM scored s LEFT JOIN (
         SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY value DESC, feature) AS r FROM (
           SELECT event_id, 'ml' AS feature, round(ml_raw, 6) AS value FROM scored UNION ALL SELECT event_id, 'behavior', round(z - 0.25, 6) FROM scored
           UNION ALL SELECT event_id, 'drift', drift - 0.4 FROM scored) WHERE value > 0) c ON c.event_id = s.event_id AND r <= 2 GROUP BY 1""",
    ("scored",),
)
def _(t):
    item = lambda n, v: F.struct(F.lit(n).alias("feature"), v.alias("value"))
    parts = F.array(item("ml", F.round("ml_raw", 6)), item("behavior", F.round(F.col("z") - 0.25, 6)), item("drift", F.col("drift") - 0.4))
    top = F.transform(fusion.top_contributors(parts, 2), lambda x: x["feature"])
    return t.scored.select("event_id", F.array_join(top, ">").alias("contributors"))
