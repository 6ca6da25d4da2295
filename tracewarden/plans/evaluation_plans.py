"""Detector evaluation over the labelled events."""

from pyspark.sql import functions as F

from tracewarden.operators import detectors, evaluation as E, fusion
from tracewarden.plans.detector_plans import RATE_FRAME, _spike_sql
from tracewarden.plans.drift_plans import feature_table
from tracewarden.operators.features import FEATURES
from tracewarden.plans.registry import query
from tracewarden.plans.signature_plans import hits
from tracewarden.plans.sql_views import DAY, VIEWS, tail
from tracewarden.functions import signatures as S

DETECTORS = {"rules": "y_rules", "ml": "y_ml", "hybrid": "y_hybrid"}


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def counts_sql(source, keys, y="y_true", p="predicted"):
    k = ", ".join(keys)
    return f"""SELECT {k + ', ' if k else ''}count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE {y} = 0 AND {p} = 1) AS fp,
      count(*) FILTER (WHERE {y} = 0 AND {p} = 0) AS tn, count(*) FILTER (WHERE {y} = 1 AND {p} = 0) AS fn FROM {source}{' GROUP BY ' + k if k else ''}"""


def zero(top, bottom):
    return f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / ({bottom}) ELSE 0 END"


def rates_sql(counts, keys, places=4, extra=""):
    cols = {"tpr": ("tp", "tp + fn"), "fpr": ("fp", "fp + tn"), "precision": ("tp", "tp + fp"), "f1": ("2 * tp", "2 * tp + fp + fn"), "accuracy": ("tp + tn", "tp + fp + tn + fn")}
    body = ", ".join(f"{'round(' if places is not None else ''}{zero(a, b)}{f', {places})' if places is not None else ''} AS \"{n}\"" for n, (a, b) in cols.items())
    return f"SELECT {''.join(k + ', ' for k in keys)}tp, fp, tn, fn, {body}{extra} FROM ({counts})"


WILSON = """, CASE WHEN tp + fn > 0 THEN round(greatest(0.0, ((tp::DOUBLE / (tp + fn)) + 3.8416::DOUBLE / (2 * (tp + fn))) / (1 + 3.8416::DOUBLE / (tp + fn)) - 1.96::DOUBLE * sqrt((tp::DOUBLE / (tp + fn)) * (fn::DOUBLE / (tp + fn)) / (tp + fn) + 3.8416::DOUBLE / (4.0::DOUBLE * (tp + fn) * (tp + fn))) / (1 + 3.8416::DOUBLE / (tp + fn))), 4) ELSE 0 END AS tpr_low,
  CASE WHEN tp + fn > 0 THEN round(least(1.0, ((tp::DOUBLE / (tp + fn)) + 3.8416::DOUBLE / (2 * (tp + fn))) / (1 + 3.8416::DOUBLE / (tp + fn)) + 1.96::DOUBLE * sqrt((tp::DOUBLE / (tp + fn)) * (fn::DOUBLE / (tp + fn)) / (tp + fn) + 3.8416::DOUBLE / (4.0::DOUBLE * (tp + fn) * (tp + fn))) / (1 + 3.8416::DOUBLE / (tp + fn))), 4) ELSE 0 END AS tpr_high"""

VIEWS["verdicts"] = (("judged",), " UNION ALL ".join(f"SELECT event_id, category, user_id, y_true, '{n}' AS detector, {c} AS predicted FROM judged" for n, c in DETECTORS.items()))
# one row per score value, highest first
VIEWS["curve"] = (("judged",), """
  SELECT score, p, n, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS positives, CAST(sum(n) OVER () AS BIGINT) AS negatives
  FROM (SELECT score, count(*) FILTER (WHERE y_true = 1) AS p, count(*) FILTER (WHERE y_true = 0) AS n FROM judged GROUP BY 1) WINDOW w AS (ORDER BY score DESC)""")
VIEWS["ablated"] = (("judged",), " UNION ALL ".join(f"SELECT event_id, user_id % 10 AS run, y_true, '{n}' AS scorer, round({a} * ml_score + {b} * rule_score + {c} * behavior_score, 6) AS score FROM judged" for n, (a, b, c) in fusion.ABLATIONS.items()))


def curve(t):
    return E.curve_points(t.judged, "y_true", "score")


@query("evl01_confusion", rates_sql(counts_sql("verdicts", ["detector"]), ["detector"]), ("verdicts",))
def _(t):
    long = E.stacked(t.judged, DETECTORS, ["y_true"])
    return E.rates(E.confusion(long, "y_true", "predicted", ["detector"]))


@query("evl02_wilson_interval", f"SELECT detector, category, tpr_low, tpr_high FROM ({rates_sql(counts_sql('verdicts', ['detector', 'category']), ['detector', 'category'], extra=WILSON)})", ("verdicts",))
def _(t):
    long = E.stacked(t.judged, DETECTORS, ["y_true", "category"])
    return E.wilson(E.confusion(long, "y_true", "predicted", ["detector", "category"])).select("detector", "category", "tpr_low", "tpr_high")


@query("evl03_roc_points", "SELECT score, round(tp / positives, 6) AS tpr, round(fp / negatives, 6) AS fpr FROM curve", ("curve",))
def _(t):
    return E.roc_points(curve(t)).select("score", *r6("tpr", "fpr"))


ROC = """roc AS (SELECT sum((fp / negatives - (fp - n) / negatives) * (tp / positives + (tp - p) / positives) / 2) AS auc, max(tp / positives - fp / negatives) AS j,
  arg_max(score, (round(tp / positives - fp / negatives, 12), score)) AS thr FROM curve)"""
PR = """pr AS (SELECT sum((tp / positives - (tp - p) / positives) * (prec + prec0) / 2) AS pr_auc, sum((tp / positives - (tp - p) / positives) * prec) AS ap,
  max(2 * prec * (tp / positives) / (prec + tp / positives + 1e-9)) AS best_f1, arg_max(score, (round(2 * prec * (tp / positives) / (prec + tp / positives + 1e-9), 12), -score)) AS thr
  FROM (SELECT *, tp / (tp + fp) AS prec, CASE WHEN tp - p + fp - n > 0 THEN (tp - p) / (tp - p + fp - n) ELSE 1.0 END AS prec0 FROM curve))"""


@query("evl03_roc_summary", f"WITH {ROC} SELECT round(auc, 6) AS auc, round(j, 6) AS youden_j, thr AS optimal_threshold FROM roc", ("curve",))
def _(t):
    return E.roc_summary(curve(t), "score").select(*r6("auc", "youden_j"), "optimal_threshold")


@query("evl04_pr_summary", f"WITH {PR} SELECT round(pr_auc, 6) AS pr_auc, round(best_f1, 6) AS best_f1, thr AS best_threshold FROM pr", ("curve",))
def _(t):
    return E.pr_summary(curve(t), "score").select(*r6("pr_auc", "best_f1"), "best_threshold")


@query("evl04_pr_points", "SELECT score, round(tp / positives, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM curve", ("curve",))
def _(t):
    return E.pr_points(curve(t)).select("score", *r6("recall", "precision"))


@query("evl05_average_precision", f"WITH {PR} SELECT round(ap, 6) AS average_precision FROM pr", ("curve",))
def _(t):
    return E.pr_summary(curve(t), "score").select(*r6("average_precision"))


@query("evl06_attack_success_rate", "SELECT category, round(CASE WHEN sum(y_true) > 0 THEN count(*) FILTER (WHERE y_true = 1 AND score < 0.5) / sum(y_true) ELSE 0 END, 6) AS asr FROM judged GROUP BY 1", ("judged",))
def _(t):
    return E.attack_success_rate(t.judged, "y_true", "score", 0.5, ["category"]).select("category", *r6("asr"))


TOP = "top AS (SELECT avg(y_true) AS pk, count(*) AS k FROM (SELECT y_true, row_number() OVER (ORDER BY score DESC, event_id DESC) AS r FROM judged) WHERE r <= greatest(1, (SELECT CAST(floor(count(*) * 0.01::DOUBLE) AS BIGINT) FROM judged)))"


@query(
    "evl07_report",
    f"WITH {ROC}, {PR}, {TOP} SELECT round(auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, (SELECT round(count(*) FILTER (WHERE score < 0.5) / count(*), 6) FROM judged WHERE y_true = 1) AS asr, round(pk, 6) AS precision_at_1_pct FROM roc, pr, top",
    ("curve",),
)
def _(t):
    return E.report(t.judged, "y_true", "score", "event_id").select(*r6("roc_auc", "pr_auc", "asr", "precision_at_1_pct"))


@query("evl08_precision_at_k", f"WITH {TOP} SELECT round(pk, 6) AS precision_at_k, k FROM top", ("judged",))
def _(t):
    return E.precision_at(t.judged, "y_true", "score", "event_id", 0.01).select(*r6("precision_at_k"), "k")


@query(
    "evl09_detection_delay",
    """SELECT entity_id, round(CASE WHEN a IS NULL THEN 0.0 WHEN b IS NULL THEN 'inf'::DOUBLE ELSE (b - a) / 1e6 END, 6) AS delay_seconds FROM (
         SELECT entity_id, min(us) FILTER (WHERE y_true = 1) AS a, min(us) FILTER (WHERE y_true = 1 AND score >= 0.7) AS b FROM judged GROUP BY 1)""",
    ("judged",),
)
def _(t):
    return E.detection_delay(t.judged, "y_true", "score", "us", 0.7, ["entity_id"]).select("entity_id", *r6("delay_seconds"))


_MEANS = ", ".join(f"avg({f}) AS {f}" for f in FEATURES)
_LIST = "[" + ", ".join(f"{{'v': {f}, 'f': '{f}'}}" for f in FEATURES) + "]"


@query(
    "evl10_error_analysis",
    f"""WITH e AS (SELECT CASE WHEN is_attack = 0 THEN 'False Positive' ELSE 'False Negative' END AS error_type, count(*) AS count, {_MEANS} FROM (
          SELECT *, CASE WHEN f6_unique_endpoints_per_min >= 3 THEN 1 ELSE 0 END AS p FROM features) WHERE is_attack <> p GROUP BY 1),
        m AS (SELECT error_type, count, CASE WHEN error_type = 'False Positive' THEN list_max(list_transform(l, lambda x: x.v)) ELSE list_min(list_transform(l, lambda x: x.v)) END AS v, l FROM (SELECT *, {_LIST} AS l FROM e))
        SELECT error_type, count, list_filter(l, lambda x: x.v = v)[1].f AS top_feature, round(v, 4) AS top_value FROM m""",
    ("features",),
)
def _(t):
    df = feature_table(t).withColumn("p", (F.col("f6_unique_endpoints_per_min") >= 3).cast("int"))
    out = E.error_analysis(df, "label", "p", FEATURES)
    return out.select("error_type", "count", "top_feature", F.round("top_value", 4).alias("top_value"))


@query(
    "evl11_latency_percentiles",
    """SELECT event_type, round(quantile_cont(request_time, 0.5) + 1e-9, 6) AS p50, round(quantile_cont(request_time, 0.95) + 1e-9, 6) AS p95, round(quantile_cont(request_time, 0.99) + 1e-9, 6) AS p99,
         round(avg(request_time) + 1e-9, 6) AS mean FROM log GROUP BY 1""",
    ("log",),
)
def _(t):
    # interpolated times may end in a five at the seventh place; the offset keeps both engines off that edge
    out = E.latency_percentiles(t.log, "request_time", ["event_type"])
    return out.select("event_type", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("p50", "p95", "p99", "mean")])


_RUNS = rates_sql(counts_sql("(SELECT *, user_id % 10 AS run FROM verdicts)", ["detector", "run"]), ["detector", "run"], None)


@query(
    "evl12_multi_run",
    f"""SELECT detector, count(*) AS runs, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg(tpr), 6) AS tpr_mean, round(stddev_pop(tpr), 6) AS tpr_std,
          round(avg(fpr), 6) AS fpr_mean, round(stddev_pop(fpr), 6) AS fpr_std FROM ({_RUNS}) GROUP BY 1""",
    ("verdicts",),
)
def _(t):
    long = E.stacked(t.judged.withColumn("run", F.col("user_id") % 10), DETECTORS, ["y_true", "run"])
    runs = E.rates(E.confusion(long, "y_true", "predicted", ["detector", "run"]), None)
    names = [f"{m}_{s}" for m in ("f1", "tpr", "fpr") for s in ("mean", "std")]
    return E.multi_run(runs, ["detector"], ["f1", "tpr", "fpr"]).select("detector", "runs", *r6(*names))


_ABL = rates_sql(counts_sql("(SELECT *, CASE WHEN score >= 0.45 THEN 1 ELSE 0 END AS predicted FROM ablated)", ["scorer", "run"]), ["scorer", "run"], None)


def ablation_runs(t, threshold=0.45):
    runs = fusion.ablation_scores(t.judged.withColumn("run", F.col("user_id") % 10), "ml_score", "rule_score", "behavior_score", ["run", "y_true"])
    return runs.withColumn("score", F.round("score", 6)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query(
    "evl13_ablation",
    f"""SELECT scorer, count(*) AS runs, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(avg("precision"), 6) AS precision_mean, round(avg(tpr), 6) AS tpr_mean,
          round(avg(fpr), 6) AS fpr_mean FROM ({_ABL}) GROUP BY 1""",
    ("ablated",),
)
def _(t):
    runs = E.rates(E.confusion(ablation_runs(t), "y_true", "predicted", ["scorer", "run"]), None)
    out = E.multi_run(runs, ["scorer"], ["f1", "precision", "tpr", "fpr"])
    return out.select("scorer", "runs", *r6("f1_mean", "f1_std", "precision_mean", "tpr_mean", "fpr_mean"))


@query(
    "evl14_mean_roc",
    """WITH c AS (SELECT scorer, run, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER g AS pos, sum(n) OVER g AS neg FROM (
         SELECT scorer, run, score, count(*) FILTER (WHERE y_true = 1) AS p, count(*) FILTER (WHERE y_true = 0) AS n FROM ablated GROUP BY 1, 2, 3)
         WINDOW w AS (PARTITION BY scorer, run ORDER BY score DESC), g AS (PARTITION BY scorer, run)),
       x AS (SELECT scorer, run, i, (tp - p + p * ((i * neg / 99 - (fp - n)) / n)) / pos AS tpr FROM c, range(0, 99) r(i) WHERE n > 0 AND i * neg >= (fp - n) * 99 AND i * neg < fp * 99
         UNION ALL SELECT DISTINCT scorer, run, 99, 1.0 FROM c)
       SELECT scorer, i, round(avg(tpr), 6) AS mean_tpr, round(i / 99, 6) AS fpr FROM x GROUP BY 1, 2""",
    ("ablated",),
)
def _(t):
    points = E.curve_points(ablation_runs(t), "y_true", "score", ["scorer", "run"])
    return E.mean_roc(points, ["run"], ["scorer"]).select("scorer", "i", *r6("mean_tpr", "fpr"))


@query(
    "evl15_f1_by_drift",
    f"""SELECT detector, level, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM (
          {rates_sql(counts_sql("(SELECT *, (user_id % 10) // 4 AS level, event_id % 5 AS run FROM verdicts)", ["detector", "level", "run"]), ["detector", "level", "run"], None)}) GROUP BY 1, 2""",
    ("verdicts",),
)
def _(t):
    df = t.judged.withColumns({"level": F.floor((F.col("user_id") % 10) / 4), "run": F.col("event_id") % 5})
    long = E.stacked(df, DETECTORS, ["y_true", "level", "run"])
    runs = E.rates(E.confusion(long, "y_true", "predicted", ["detector", "level", "run"]), None)
    return E.multi_run(runs, ["detector", "level"], ["f1"]).select("detector", "level", *r6("f1_mean", "f1_std"))


PAIRS = {"rules_vs_hybrid": ("y_rules", "y_hybrid"), "ml_vs_hybrid": ("y_ml", "y_hybrid"), "rules_vs_ml": ("y_rules", "y_ml")}
_PAIRED = " UNION ALL ".join(
    f"SELECT '{n}' AS pair, count(*) FILTER (WHERE {a} <> y_true AND {b} = y_true) AS n_ab, count(*) FILTER (WHERE {a} = y_true AND {b} <> y_true) AS n_ba FROM judged" for n, (a, b) in PAIRS.items()
)


@query(
    "evl16_mcnemar",
    f"""SELECT pair, n_ab, n_ba, round(s, 4) AS statistic, round(p, 4) AS p_value, p < 0.05 AS significant,
          CASE WHEN n_ab + n_ba = 0 THEN 'Same verdict everywhere' WHEN p < 0.01 THEN 'p below 0.01: the detectors differ' WHEN p < 0.05 THEN 'p below 0.05: the detectors probably differ'
            ELSE 'p of 0.05 or more: no difference shown' END AS interpretation
        FROM (SELECT *, least(1.0, 2.0 * {tail('r')}) AS p FROM (SELECT *, sqrt(s) AS r FROM (SELECT *, CASE WHEN n_ab + n_ba > 0 THEN power(abs(n_ab - n_ba) - 1, 2) / (n_ab + n_ba) ELSE 0.0 END AS s FROM ({_PAIRED}))))""",
    ("judged",),
)
def _(t):
    out = E.mcnemar(E.paired_counts(t.judged, "y_true", PAIRS))
    return out.withColumns({"statistic": F.round("statistic", 4), "p_value": F.round("p_value", 4)})


@query("evl17_comparison", rates_sql(counts_sql("verdicts", ["detector"]), ["detector"], extra=WILSON), ("verdicts",))
def _(t):
    return E.comparison(t.judged, "y_true", DETECTORS)


@query(
    "evl18_per_attack",
    f"""SELECT category, rules_tpr, ml_tpr, hybrid_tpr, concat_ws('/', CASE WHEN hybrid_tpr = b THEN 'Hybrid' END, CASE WHEN ml_tpr = b THEN 'ML' END, CASE WHEN rules_tpr = b THEN 'Rules' END) AS winner,
          round(hybrid_tpr - rules_tpr, 6) AS delta_vs_rules FROM (SELECT *, greatest(rules_tpr, ml_tpr, hybrid_tpr) AS b FROM (
            SELECT category, max(tpr) FILTER (WHERE detector = 'rules') AS rules_tpr, max(tpr) FILTER (WHERE detector = 'ml') AS ml_tpr, max(tpr) FILTER (WHERE detector = 'hybrid') AS hybrid_tpr
            FROM ({rates_sql(counts_sql('verdicts', ['detector', 'category']), ['detector', 'category'])}) GROUP BY 1))""",
    ("verdicts",),
)
def _(t):
    out = E.per_attack(E.comparison(t.judged, "y_true", DETECTORS, ["category"]), "category")
    return out.withColumn("delta_vs_rules", F.round("delta_vs_rules", 6))


_SCORECARD = f"""WITH det AS (SELECT event_id, 'sql_injection' AS rule FROM log WHERE {hits("(request_uri || ' ' || http_referer)", S.SQLI_SIGNATURES)} > 0
          UNION ALL SELECT event_id, 'path_traversal' FROM log WHERE {hits('request_uri', S.TRAVERSAL_SIGNATURES)} > 0
          UNION ALL SELECT event_id, 'login_brute_force' FROM (SELECT *, {RATE_FRAME} AS n FROM log WHERE status IN (401, 403) AND request_uri = '/login') WHERE n > 2
          UNION ALL SELECT event_id, 'rate_limit' FROM (SELECT *, {RATE_FRAME} AS n FROM log) WHERE n > 6 UNION ALL SELECT event_id, rule FROM ({_spike_sql('')})),
        d AS (SELECT event_type, rule, remote_addr FROM det JOIN log USING (event_id)), names(rule) AS (VALUES ('sql_injection'), ('path_traversal'), ('login_brute_force'), ('rate_limit'), ('error_rate_spike')),
        grid AS (SELECT event_type, rule, remote_addr, is_attack FROM log, names), hit AS (SELECT event_type, rule, remote_addr, count(*) AS n FROM d GROUP BY ALL),
        c AS (SELECT event_type, rule, count(*) FILTER (WHERE is_attack AND n IS NOT NULL) AS tp, count(*) FILTER (WHERE NOT is_attack AND n IS NOT NULL) AS fp,
            count(*) FILTER (WHERE NOT is_attack AND n IS NULL) AS tn, count(*) FILTER (WHERE is_attack AND n IS NULL) AS fn FROM grid LEFT JOIN hit USING (event_type, rule, remote_addr) GROUP BY 1, 2),
        r AS ({rates_sql('SELECT * FROM c', ['event_type', 'rule'])})
        SELECT r.*, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM hit h WHERE h.event_type = r.event_type AND h.rule = r.rule), 0) AS detections, tpr >= 0.95 AS tpr_ok, fpr <= 0.05 AS fpr_ok FROM r"""


def scorecard(t):
    found = detectors.rule_set(t.log, rate_threshold=6.0, auth_threshold=2, width_us=DAY, minute_us=DAY)
    found = found.join(t.log.select("event_id", "event_type"), "event_id")
    events = t.log.select("event_type", "remote_addr", F.col("is_attack").cast("int").alias("label"))
    return E.scorecard(events, found, scenario="event_type", source="remote_addr", label="label", rules=detectors.RULES)


@query("evl19_scorecard", _SCORECARD, ("log",))
def _(t):
    return scorecard(t)


@query(
    "evl19_overall_verdict",
    f"SELECT count(*) AS cells, count(*) FILTER (WHERE NOT (tpr_ok AND fpr_ok)) AS missed, count(*) FILTER (WHERE NOT (tpr_ok AND fpr_ok)) = 0 AS all_targets_met FROM ({_SCORECARD})",
    ("log",),
)
def _(t):
    return E.scorecard_verdict(scorecard(t))


@query("evl20_quality_gate", f"SELECT detector, f1, tpr, fpr, f1 >= 0.85 AND tpr >= 0.9 AND fpr <= 0.05 AS passed FROM ({rates_sql(counts_sql('verdicts', ['detector']), ['detector'])})", ("verdicts",))
def _(t):
    long = E.stacked(t.judged, DETECTORS, ["y_true"])
    return E.quality_gate(E.rates(E.confusion(long, "y_true", "predicted", ["detector"]))).select("detector", "f1", "tpr", "fpr", "passed")


EVASION = """ev AS (SELECT category, attempts, evaded, round(evaded / attempts, 3) AS esr, CASE WHEN evaded / attempts > 0.5 THEN 'HIGH RISK' WHEN evaded / attempts < 0.2 THEN 'Acceptable' ELSE 'Medium risk' END AS risk
  FROM (SELECT category, count(*) AS attempts, count(*) FILTER (WHERE y_hybrid = 0) AS evaded FROM judged WHERE y_true = 1 GROUP BY 1))"""


@query("evl21_evasion_table", f"WITH {EVASION} SELECT * FROM ev ORDER BY esr DESC, category", ("judged",))
def _(t):
    return E.evasion_table(t.judged.filter("y_true = 1"), "category", "y_hybrid")


@query("evl21_evasion_average", f"WITH {EVASION} SELECT round(avg(esr), 6) AS average_esr, avg(esr) <= 0.3 AS target_met FROM ev", ("judged",))
def _(t):
    out = E.evasion_average(E.evasion_table(t.judged.filter("y_true = 1"), "category", "y_hybrid"))
    return out.withColumn("average_esr", F.round("average_esr", 6))


_ROBUST = """rb AS (SELECT model, round(count(*) FILTER (WHERE part = 'clean' AND p = 1) / count(*) FILTER (WHERE part = 'clean'), 4) AS clean_detection_rate,
  round(count(*) FILTER (WHERE part = 'perturbed' AND p = 1) / count(*) FILTER (WHERE part = 'perturbed'), 4) AS adversarial_detection_rate,
  round(count(*) FILTER (WHERE part = 'normal' AND p = 1) / count(*) FILTER (WHERE part = 'normal'), 4) AS false_positive_rate FROM (
    SELECT CASE WHEN y_true = 0 THEN 'normal' WHEN category = 'error' THEN 'clean' ELSE 'perturbed' END AS part, 'before' AS model, y_rules AS p FROM judged
    UNION ALL SELECT CASE WHEN y_true = 0 THEN 'normal' WHEN category = 'error' THEN 'clean' ELSE 'perturbed' END, 'after', y_hybrid FROM judged) GROUP BY 1)"""


def robustness_table(t):
    part = F.when(F.col("y_true") == 0, "normal").when(F.col("category") == "error", "clean").otherwise("perturbed")
    long = E.stacked(t.judged.withColumn("part", part), {"before": "y_rules", "after": "y_hybrid"}, ["part"], name="model")
    return E.robustness(long, "model", "part", "predicted")


@query("evl22_robustness", f"WITH {_ROBUST} SELECT * FROM rb", ("judged",))
def _(t):
    return robustness_table(t)


@query(
    "evl22_robustness_gain",
    f"""WITH {_ROBUST} SELECT round(a.adversarial_detection_rate - b.adversarial_detection_rate, 4) AS adversarial_robustness_gain, round(a.clean_detection_rate - b.clean_detection_rate, 4) AS clean_accuracy_delta,
          round(a.false_positive_rate - b.false_positive_rate, 4) AS fpr_delta FROM rb a, rb b WHERE a.model = 'after' AND b.model = 'before'""",
    ("judged",),
)
def _(t):
    return E.robustness_gain(robustness_table(t))


@query(
    "evl23_component_breakdown",
    """SELECT n AS true_attacks, m AS ml, r AS rule, b AS behavior, round(m / greatest(n, 1), 6) AS ml_rate, round(r / greatest(n, 1), 6) AS rule_rate, round(b / greatest(n, 1), 6) AS behavior_rate FROM (
         SELECT count(*) FILTER (WHERE is_attack) AS n, count(*) FILTER (WHERE is_attack AND ml_raw >= 0.55) AS m, count(*) FILTER (WHERE is_attack AND rule_triggered) AS r, count(*) FILTER (WHERE is_attack AND z >= 2.5) AS b FROM scored)""",
    ("scored",),
)
def _(t):
    flags = {"ml": F.col("ml_flag"), "rule": F.col("rule_flag"), "behavior": F.col("behavior_flag")}
    out = E.component_breakdown(fusion.component_flags(t.scored), F.col("is_attack"), flags)
    return out.select("true_attacks", "ml", "rule", "behavior", *r6("ml_rate", "rule_rate", "behavior_rate"))
