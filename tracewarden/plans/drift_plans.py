"""Statistics and drift over the daily behaviour features."""

from pyspark.sql import functions as F

from tracewarden.operators import baseline, drift, evaluation, features, fusion
from tracewarden.operators.features import FEATURES
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import DAY, VIEWS, tail
from tracewarden.session import cut_lineage


def feature_table(t):
    """Daily features with a label, rounded as stored, kept as a table because several tests read it."""
    df = features.behaviour_features(t.log, DAY, extra={"label": F.max(F.col("is_attack").cast("int"))})
    return cut_lineage(df.select("ip", "bucket", "label", *[F.round(f, 6).alias(f) for f in FEATURES]))


def halves(t):
    """Long feature tables of days 1-15 and of the days after."""
    df = feature_table(t)
    split = F.col("bucket") < df.agg(F.min("bucket") + F.lit(15)).scalar()
    flagged = drift.long_form(df.withColumn("early", split), FEATURES, ["early"])
    return flagged.filter("early").drop("early"), flagged.filter("not early").drop("early")


def labelled(t):
    return drift.long_form(feature_table(t), FEATURES, ["label"])


_LONG = " UNION ALL ".join(f"SELECT bucket, is_attack AS label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM features" for f in FEATURES)
VIEWS["long"] = (("features",), f"SELECT *, bucket < (SELECT min(bucket) + 15 FROM features) AS early FROM ({_LONG})")
VIEWS["psi"] = (("long",), """
  SELECT feature, coalesce(round(sum((pa - pe) * ln(pa / pe)), 4), 0) AS psi FROM (
    SELECT DISTINCT feature FROM long) LEFT JOIN (
    SELECT feature, bin, greatest(e / (sum(e) OVER f + 1e-6::DOUBLE), 1e-6::DOUBLE) AS pe, greatest(a / (sum(a) OVER f + 1e-6::DOUBLE), 1e-6::DOUBLE) AS pa FROM (
      SELECT b.feature, b.bin, count(*) FILTER (WHERE early) AS e, count(*) FILTER (WHERE NOT early) AS a FROM (
        SELECT feature, unnest(range(len(edges) - 1)) AS bin, unnest(edges[1:len(edges) - 1]) AS lo, unnest(edges[2:]) AS hi, len(edges) AS k FROM (
          SELECT feature, list_sort(list_distinct(list_transform(range(11), lambda i: s[CAST(floor(i / 10.0::DOUBLE * (len(s) - 1)) AS BIGINT) + 1]
            + (s[CAST(ceil(i / 10.0::DOUBLE * (len(s) - 1)) AS BIGINT) + 1] - s[CAST(floor(i / 10.0::DOUBLE * (len(s) - 1)) AS BIGINT) + 1])
            * (i / 10.0::DOUBLE * (len(s) - 1) - floor(i / 10.0::DOUBLE * (len(s) - 1)))))) AS edges
          FROM (SELECT feature, list(value ORDER BY value) AS s FROM long WHERE early GROUP BY 1)) WHERE len(edges) >= 3) b
      LEFT JOIN long l ON l.feature = b.feature AND l.value >= b.lo AND (l.value < b.hi OR (b.bin = b.k - 2 AND l.value <= b.hi)) GROUP BY 1, 2)
    WINDOW f AS (PARTITION BY feature)) USING (feature) GROUP BY 1""")
VIEWS["ks"] = (("long",), """
  SELECT feature, max(abs(ce / ne - ca / na)) AS ks_stat, sqrt(CAST(max(ne) * max(na) AS DOUBLE) / (max(ne) + max(na))) AS en FROM (
    SELECT feature, value, sum(e) OVER w AS ce, sum(a) OVER w AS ca, sum(e) OVER (PARTITION BY feature) AS ne, sum(a) OVER (PARTITION BY feature) AS na FROM (
      SELECT feature, value, count(*) FILTER (WHERE early) AS e, count(*) FILTER (WHERE NOT early) AS a FROM long GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY 1""")
VIEWS["ks_p"] = (("ks",), """
  SELECT feature, ks_stat, CASE WHEN en * ks_stat < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, (SELECT sum(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0::DOUBLE * i * i * en * ks_stat * en * ks_stat)) FROM range(1, 101) r(i)))) END AS ks_p FROM ks""")
VIEWS["drift_report"] = (("psi", "ks_p"), """
  SELECT feature, psi, CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.2 THEN 'WARNING' ELSE 'DRIFT' END AS psi_status, round(ks_stat, 4) AS ks_stat, round(ks_p, 6) AS ks_p,
    ks_p < 0.05 AS ks_drift, CASE WHEN psi > 0.2 OR ks_p < 0.05 THEN 'DRIFT_DETECTED' WHEN psi > 0.1 THEN 'WARNING' ELSE 'STABLE' END AS status FROM psi JOIN ks_p USING (feature)""")


@query("st01_psi", "SELECT feature, psi FROM psi", ("psi",))
def _(t):
    return drift.psi(*halves(t))


@query("st02_kolmogorov", "SELECT feature, round(ks_stat, 6) AS ks_stat, round(ks_p, 6) AS ks_p FROM ks_p", ("ks_p",))
def _(t):
    return drift.kolmogorov(*halves(t)).select("feature", F.round("ks_stat", 6).alias("ks_stat"), F.round("ks_p", 6).alias("ks_p"))


@query("st03_drift_report", "SELECT * FROM drift_report ORDER BY psi DESC, feature", ("drift_report",))
def _(t):
    return drift.drift_report(*halves(t)).withColumn("ks_p", F.round("ks_p", 6))


@query(
    "st04_retrain_decision",
    """SELECT a OR b AS should_retrain, concat_ws('; ', CASE WHEN a THEN 'PSI > 0.20 on 2+ features' END, CASE WHEN b THEN 'KS-test drift detected' END) AS triggers,
         CASE WHEN a OR b THEN 'Immediate retraining' ELSE 'Continue monitoring' END AS recommended_action
       FROM (SELECT count(*) FILTER (WHERE psi > 0.2) >= 2 AS a, bool_or(ks_drift) AS b FROM drift_report)""",
    ("drift_report",),
)
def _(t):
    return drift.retrain_decision(drift.drift_report(*halves(t))).withColumn("triggers", F.array_join("triggers", "; "))


@query(
    "st05_promotion_gate",
    """WITH m AS (SELECT d, round(tp / (tp + fp + 0.5 * 0) , 12) AS x, tp, fp, fn, tn FROM (
         SELECT d, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn
         FROM (SELECT 'cur' AS d, y_true AS y, y_rules AS p FROM judged UNION ALL SELECT 'new', y_true, y_hybrid FROM judged) GROUP BY 1)),
       r AS (SELECT d, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(fp / (fp + tn), 4) AS fpr FROM m)
       SELECT n.f1 AS new_f1, n.fpr AS new_fpr, n.f1 > c.f1 - 0.01 AND n.fpr <= c.fpr + 0.005 AS promote, n.fpr > 0.05 AS roll_back FROM r n, r c WHERE n.d = 'new' AND c.d = 'cur'""",
    ("judged",),
)
def _(t):
    one = lambda p: evaluation.rates(evaluation.confusion(t.judged, "y_true", p))
    return drift.promotion(one("y_rules"), one("y_hybrid"))


VIEWS["moments"] = (("long",), """
  SELECT feature, count(*) FILTER (WHERE label = 0) AS nc, count(*) FILTER (WHERE label = 1) AS ac, avg(value) FILTER (WHERE label = 0) AS nm, avg(value) FILTER (WHERE label = 1) AS am,
    var_samp(value) FILTER (WHERE label = 0) AS nv, var_samp(value) FILTER (WHERE label = 1) AS av FROM long GROUP BY 1""")
VIEWS["welch"] = (("moments",), f"SELECT *, least(1.0, 2.0 * {tail('abs_t')}) AS p FROM (SELECT *, abs(t) AS abs_t FROM (SELECT *, (nm - am) / sqrt(nv / nc + av / ac) AS t FROM moments))")
VIEWS["mwu"] = (("long",), f"""
  SELECT feature, u, CASE WHEN sp > 0 THEN least(1.0, 2.0 * {tail('z')}) ELSE 1.0 END AS p FROM (SELECT *, (greatest(u, n * a - u) - n * a / 2 - 0.5) / sp AS z FROM (
    SELECT feature, rs - n * (n + 1) / 2 AS u, n, a, sqrt(n * a / 12 * ((n + a + 1) - ties / ((n + a) * (n + a - 1)))) AS sp FROM (
      SELECT feature, sum(n * (upto - t + (t + 1) / 2)) AS rs, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(a) AS DOUBLE) AS a, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (
        SELECT feature, n, a, n + a AS t, sum(n + a) OVER (PARTITION BY feature ORDER BY value) AS upto FROM (
          SELECT feature, value, count(*) FILTER (WHERE label = 0) AS n, count(*) FILTER (WHERE label = 1) AS a FROM long GROUP BY 1, 2)) GROUP BY 1)))""")
VIEWS["kl"] = (("long",), """
  SELECT feature, sum(da * ln(da / dn)) / sum(da) - ln(sum(da) / sum(dn)) AS kl FROM (
    SELECT s.feature, b, coalesce(n, 0) / (tn * w) + 1e-10::DOUBLE AS dn, coalesce(a, 0) / (ta * w) + 1e-10::DOUBLE AS da FROM (
      SELECT feature, min(value) AS lo, (max(value) + 1e-9::DOUBLE - min(value)) / 50 AS w, count(*) FILTER (WHERE label = 0) AS tn, count(*) FILTER (WHERE label = 1) AS ta, unnest(range(50)) AS b FROM long GROUP BY 1) s
    LEFT JOIN (SELECT l.feature, least(CAST(floor((value - lo) / w) AS BIGINT), 49) AS b, count(*) FILTER (WHERE label = 0) AS n, count(*) FILTER (WHERE label = 1) AS a
      FROM long l JOIN (SELECT feature, min(value) AS lo, (max(value) + 1e-9::DOUBLE - min(value)) / 50 AS w FROM long GROUP BY 1) q USING (feature) GROUP BY 1, 2) f USING (feature, b)) GROUP BY 1""")


@query("st06_welch", "SELECT feature, round(t, 6) AS t_stat, round(p, 6) AS p_ttest FROM welch", ("welch",))
def _(t):
    return drift.welch(drift.class_moments(labelled(t)), large_samples=True).select("feature", F.round("t_stat", 6).alias("t_stat"), F.round("p_ttest", 6).alias("p_ttest"))


# tail of Student's t: Simpson's rule over the angle atan(t / sqrt(freedom)), as far as the density can be seen
VIEWS["student"] = (("moments",), """
  SELECT feature, t, v, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * area AS p FROM (
    SELECT feature, t, v, (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(top * i / 4000), v - 1)) FROM range(4001) r(i)) * top / 12000 AS area FROM (
      SELECT *, least(atan(abs(t) / sqrt(v)), 12 / sqrt(v)) AS top FROM (
        SELECT feature, (nm - am) / sqrt(nv / nc + av / ac) AS t, pow(nv / nc + av / ac, 2) / (pow(nv / nc, 2) / (nc - 1) + pow(av / ac, 2) / (ac - 1)) AS v FROM moments)))""")


@query("st06_welch_student", "SELECT feature, round(t, 6) AS t_stat, round(v, 4) AS freedom, round(abs(p), 6) AS p_ttest FROM student", ("student",))
def _(t):
    found = drift.welch(drift.class_moments(labelled(t)))
    return found.select("feature", F.round("t_stat", 6).alias("t_stat"), F.round("freedom", 4).alias("freedom"), F.round("p_ttest", 6).alias("p_ttest"))


@query("st07_mann_whitney", "SELECT feature, round(u, 6) AS u_stat, round(p, 6) AS p_mw FROM mwu", ("mwu",))
def _(t):
    return drift.mann_whitney(labelled(t)).select("feature", F.round("u_stat", 6).alias("u_stat"), F.round("p_mw", 6).alias("p_mw"))


_D = "CASE WHEN sqrt((nv + av) / 2) > 0 THEN (am - nm) / sqrt((nv + av) / 2) ELSE 0 END"
_SIZE = "CASE WHEN abs(d) >= 2.0 THEN 'very large' WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' ELSE 'small' END"


@query("st08_cohens_d", f"SELECT feature, round(d, 6) AS cohens_d, {_SIZE} AS effect_size FROM (SELECT feature, {_D} AS d FROM moments)", ("moments",))
def _(t):
    return drift.effect_size(drift.class_moments(labelled(t))).select("feature", F.round("cohens_d", 6).alias("cohens_d"), "effect_size")


@query("st09_kl_divergence", "SELECT feature, round(kl, 6) AS kl_divergence FROM kl", ("kl",))
def _(t):
    return drift.kl_divergence(labelled(t)).select("feature", F.round("kl_divergence", 6).alias("kl_divergence"))


@query(
    "st10_discrimination_report",
    f"""SELECT feature, round(nm, 4) AS normal_mean, round(am, 4) AS attack_mean, round(am - nm, 4) AS mean_delta, round(d, 4) AS cohens_d, {_SIZE} AS effect_size, round(kl, 4) AS kl_divergence,
          round(m.p, 6) AS p_value_mw, m.p < 0.05 AS significant, abs(d) >= 0.5 AS recommended
        FROM (SELECT *, {_D} AS d FROM moments) JOIN mwu m USING (feature) JOIN kl USING (feature) WHERE nc >= 10 AND ac >= 10""",
    ("moments", "mwu", "kl"),
)
def _(t):
    df = drift.discrimination_report(labelled(t))
    r = lambda c, n, p=4: F.round(c, p).alias(n)
    return df.select(
        "feature", r("n_mean", "normal_mean"), r("a_mean", "attack_mean"), r("mean_delta", "mean_delta"), r("cohens_d", "cohens_d"), "effect_size",
        r("kl_divergence", "kl_divergence"), r("p_mw", "p_value_mw", 6), "significant", "recommended",
    )


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query(
    "st11_correlations",
    " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 6) AS r, coalesce(abs(corr({a}, {b})) > 0.8, false) AS redundant FROM features".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"') for a, b in _PAIRS),
    ("features",),
)
def _(t):
    return drift.correlations(feature_table(t), FEATURES).withColumn("r", F.round("r", 6))


@query(
    "st12_poisson_distance",
    """WITH c AS (SELECT hour_n AS n, count(*) AS w, sum(count(*)) OVER (ORDER BY hour_n) AS cum FROM (SELECT remote_addr, us // 3600000000 AS h, count(*) AS hour_n FROM log GROUP BY 1, 2) GROUP BY 1),
       s AS (SELECT CAST(sum(w) AS DOUBLE) AS total, sum(n * w) / sum(w) AS lam FROM c), p AS (SELECT i, exp(-lam + i * ln(lam) - lgamma(i + 1)) AS pmf FROM s, range(0, 200) r(i))
       SELECT round(max(greatest(cum / total - f, f - (cum - w) / total)), 6) AS ks_stat FROM (SELECT c.*, total, (SELECT sum(pmf) FROM p WHERE i <= c.n) AS f FROM c, s)""",
    ("log",),
)
def _(t):
    counts = baseline.requests_per_bucket(t.log, 3_600_000_000).groupBy("n").agg(F.count(F.lit(1)).alias("weight"))
    return baseline.poisson_distance(counts).select(F.round("ks_stat", 6).alias("ks_stat"))


@query("st13_min_max", "SELECT event_id, round((z - lo) / (hi - lo), 6) AS scaled, 1.0::DOUBLE AS constant FROM scored, (SELECT min(z) AS lo, max(z) AS hi FROM scored)", ("scored",))
def _(t):
    df = fusion.min_max(t.scored.withColumn("one", F.lit(1.0)), "z", "scaled")
    return fusion.min_max(df, "one", "constant").select("event_id", F.round("scaled", 6).alias("scaled"), "constant")


@query(
    "st14_mean_shift",
    "SELECT feature, round((avg(value) FILTER (WHERE NOT early) - avg(value) FILTER (WHERE early)) / stddev_samp(value) FILTER (WHERE early), 6) AS z FROM long GROUP BY 1",
    ("long",),
)
def _(t):
    return drift.mean_shift(*halves(t)).select("feature", F.round("z", 6).alias("z"))


@query(
    "st15_tracked_false_alarms",
    f"""WITH RECURSIVE d AS (SELECT detector, bucket, fpr, row_number() OVER (PARTITION BY detector ORDER BY bucket) AS rn FROM (
          SELECT detector, us // {DAY} AS bucket, CASE WHEN count(*) FILTER (WHERE y = 0) > 0 THEN count(*) FILTER (WHERE y = 0 AND p = 1) / count(*) FILTER (WHERE y = 0) ELSE 0 END AS fpr FROM (
            SELECT 'rules' AS detector, us, y_true AS y, y_rules AS p FROM judged UNION ALL SELECT 'ml', us, y_true, y_ml FROM judged) GROUP BY 1, 2)),
        e AS (SELECT detector, bucket, rn, fpr, 0.0::DOUBLE AS b FROM d WHERE rn = 1 UNION ALL SELECT d.detector, d.bucket, d.rn, d.fpr, 0.1 * e.fpr + 0.9 * e.b FROM e JOIN d ON d.detector = e.detector AND d.rn = e.rn + 1)
        SELECT detector, bucket, round(fpr, 6) AS fpr, round(0.45 * (1 + b), 6) AS adjusted_threshold FROM e""",
    ("judged",),
)
def _(t):
    long = evaluation.stacked(t.judged.withColumn("bucket", F.floor(F.col("us") / DAY)), {"rules": "y_rules", "ml": "y_ml"}, ["bucket", "y_true"])
    daily = evaluation.rates(evaluation.confusion(long, "y_true", "predicted", ["detector", "bucket"]), places=None)
    df = drift.tracked_false_alarms(daily.select("detector", "bucket", "fpr"), "detector", "bucket", "fpr", base=0.45)
    return df.select("detector", "bucket", F.round("fpr", 6).alias("fpr"), F.round("adjusted_threshold", 6).alias("adjusted_threshold"))
