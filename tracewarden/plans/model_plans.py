"""Model jobs on the daily behaviour features.  Forests draw by MD5, so SQL grows the same ones (``forest_sql``)."""

from pyspark.sql import functions as F

from tracewarden.operators import evaluation as E
from tracewarden.operators import features, forest, lookups
from tracewarden.operators.features import FEATURES
from tracewarden.plans.drift_plans import feature_table
from tracewarden.plans.evaluation_plans import DETECTORS, _RUNS, counts_sql, r6, rates_sql, zero
from tracewarden.plans.forest_sql import forest as forest_ctes
from tracewarden.plans.forest_sql import scores
from tracewarden.plans.registry import query
from tracewarden.session import cut_lineage


def table(t):
    return feature_table(t).withColumn("row_id", F.concat_ws("@", "ip", "bucket"))


def forest_of(df, **settings):
    return cut_lineage(forest.fit(df, "row_id", FEATURES, **settings))


_TABLE = f"tbl AS MATERIALIZED (SELECT ip, bucket, ip || '@' || bucket AS id, is_attack AS label, [{', '.join(f'CAST({f} AS DOUBLE)' for f in FEATURES)}] AS x FROM features)"
_ALL = "SELECT '' AS grp, id, x FROM tbl"


@query(
    "ml01_isolation_forest",
    f"WITH {_TABLE}, {forest_ctes('f', _ALL)} SELECT tree, count(*) AS nodes, max(sampled) AS sampled FROM (SELECT tree, NULL AS sampled FROM f UNION ALL SELECT tree, CAST(sampled AS INTEGER) FROM f_leaf) GROUP BY tree",
    ("features",),
)
def _(t):
    nodes = forest_of(table(t))
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"), F.max("sampled").alias("sampled"))


@query("ml02_anomaly_scores", f"WITH {_TABLE}, {forest_ctes('f', _ALL)}, {scores('f', _ALL, 's')} SELECT ip, bucket, round(score, 6) AS score FROM s JOIN tbl USING (id)", ("features",))
def _(t):
    df = table(t)
    return forest.score(df, forest_of(df), FEATURES).select("ip", "bucket", F.round("score", 6).alias("score"))


@query(
    "ml03_contamination_cut",
    "SELECT event_id, CAST(ml_score > (SELECT quantile_cont(ml_score, 0.9) FROM judged) AS INTEGER) AS predicted FROM judged",
    ("judged",),
)
def _(t):
    return forest.by_contamination(t.judged, "ml_score", 0.1).select("event_id", "predicted")


@query(
    "ml04_feature_matrix",
    "SELECT ip, bucket, " + " || ',' || ".join(f"CAST(CAST(floor({f} * 1000 + 0.5) AS BIGINT) AS VARCHAR)" for f in FEATURES) + " AS features FROM features",
    ("features",),
)
def _(t):
    df = features.feature_array(feature_table(t))
    return df.select("ip", "bucket", F.array_join(F.transform("features", lambda x: F.floor(x * 1000 + 0.5).cast("string")), ",").alias("features"))


@query(
    "ml05_stratified_split",
    "SELECT event_id, y_true, CASE WHEN CAST('0x' || substr(md5(event_id || '|42'), 1, 7) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM judged",
    ("judged",),
)
def _(t):
    return forest.stratified_split(t.judged, "event_id").select("event_id", "y_true", "part")


def _hash_sql(name, seed):
    return f"CAST('0x' || substr(md5({name} || '|{seed}'), 1, 7) AS BIGINT)"


_SPLIT = f"split AS MATERIALIZED (SELECT *, CASE WHEN {_hash_sql('id', 42)} % 100 < 20 THEN 'test' ELSE 'train' END AS part, {_hash_sql('id', 43)} % 100 AS u FROM tbl)"
_WIDTHS = {m: max(1, int(round(m * len(FEATURES)))) for m in forest.GRID_MAX_FEATURES}


def _search_sql():
    train, every = "SELECT '' AS grp, id, x FROM split WHERE part = 'train'", "SELECT '' AS grp, id, x FROM split"
    ctes, long = [], []
    for k, (m, width) in enumerate(_WIDTHS.items()):
        ctes += [forest_ctes(f"f{k}", train, max(forest.GRID_TREES), width), scores(f"f{k}", every, f"s{k}", forest.GRID_TREES)]
        long.append(f"SELECT {m}::DOUBLE AS max_features, size AS trees, id, score FROM s{k}")
    probs = ", ".join(str(1 - c) for c in forest.GRID_CONTAMINATION)
    cuts = f"SELECT max_features, trees, unnest([{probs}]) AS prob, unnest(quantile_cont(score, [{probs}])) AS cut FROM long WHERE part = 'train' GROUP BY max_features, trees"
    keys = ["max_features", "trees", "contamination"]
    judged = "(SELECT max_features, trees, round(1 - prob::DOUBLE, 4) AS contamination, label, CAST(score > cut AS INTEGER) AS predicted FROM long JOIN cuts USING (max_features, trees) WHERE part = 'test')"
    return f"WITH {_TABLE}, {_SPLIT}, {', '.join(ctes)}, long AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(long)}) JOIN split USING (id)), cuts AS ({cuts}) {rates_sql(counts_sql(judged, keys, 'label'), keys)}"


def _folds_sql():
    others = "SELECT CAST(held AS VARCHAR) AS grp, id, x FROM folded, range(5) AS h(held) WHERE held <> fold"
    every = "SELECT CAST(held AS VARCHAR) AS grp, id, x FROM folded, range(5) AS h(held)"
    judged = "(SELECT fold, label, CAST(score > cut AS INTEGER) AS predicted FROM scored JOIN cuts USING (grp) WHERE grp = CAST(fold AS VARCHAR))"
    t = f"{forest.student_975(4)}::DOUBLE"
    return f"""WITH {_TABLE}, folded AS MATERIALIZED (SELECT *, {_hash_sql('id', 42)} % 5 AS fold FROM tbl), {forest_ctes('f', others)}, {scores('f', every, 's')},
      scored AS (SELECT grp, score, fold, label FROM s JOIN folded USING (id)), cuts AS (SELECT grp, quantile_cont(score, 0.9) AS cut FROM scored WHERE grp <> CAST(fold AS VARCHAR) GROUP BY grp),
      r AS ({rates_sql(counts_sql(judged, ['fold'], 'label'), ['fold'])})
      SELECT round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1, round(avg(precision), 6) AS mean_precision, round(avg(tpr), 6) AS mean_recall,
        round(avg(f1) - {t} * stddev_samp(f1) / sqrt(5), 6) AS f1_low, round(avg(f1) + {t} * stddev_samp(f1) / sqrt(5), 6) AS f1_high FROM r"""


def _curve_sql():
    sizes = "(SELECT unnest([20, 40, 60, 80, 100])::INTEGER AS size)"
    train = f"SELECT CAST(size AS VARCHAR) AS grp, id, x FROM split, {sizes} WHERE part = 'train' AND u < size"
    every = f"SELECT CAST(size AS VARCHAR) AS grp, id, x FROM split, {sizes} WHERE part = 'test' OR u < size"
    judged = "(SELECT CAST(grp AS INTEGER) AS size, label, CAST(score > cut AS INTEGER) AS predicted FROM scored JOIN cuts USING (grp) WHERE part = 'test')"
    return f"""WITH {_TABLE}, {_SPLIT}, {forest_ctes('f', train)}, {scores('f', every, 's')}, scored AS (SELECT grp, score, part, label FROM s JOIN split USING (id)),
      cuts AS (SELECT grp, quantile_cont(score, 0.9) AS cut FROM scored WHERE part = 'train' GROUP BY grp) {rates_sql(counts_sql(judged, ['size'], 'label'), ['size'])}"""


WORN = ("f1_request_frequency", "f3_failed_request_ratio", "f6_unique_endpoints_per_min")


def _augmented_sql():
    worn = ", ".join(f"x[{k}] * 0.85::DOUBLE" if f in WORN else f"x[{k}]" for k, f in enumerate(FEATURES, 1))
    parts = f"""parts AS MATERIALIZED (SELECT 'normal' AS part, '0-' || id AS id, id AS own, x FROM tbl WHERE label = 0 UNION ALL SELECT 'clean', '1-' || id, id, x FROM tbl WHERE label = 1
      UNION ALL SELECT 'perturbed', '2-' || id, id, [{worn}] FROM tbl WHERE label = 1)"""
    every, normal = "SELECT '' AS grp, id, x FROM parts", "SELECT '' AS grp, own AS id, x FROM parts WHERE part = 'normal'"

    def share(part):
        of = f"count(*) FILTER (WHERE part = '{part}'"
        return f"round({zero(of + ' AND predicted = 1)', of + ')')}, 4)"

    both = " UNION ALL ".join(f"SELECT '{m}' AS model, part, CAST(score > (SELECT quantile_cont(score, 0.9) FROM {s}) AS INTEGER) AS predicted FROM {s} JOIN parts USING (id)" for m, s in (("before", "sb"), ("after", "sa")))
    return f"""WITH {_TABLE}, {parts}, {forest_ctes('fb', normal)}, {scores('fb', every, 'sb')}, {forest_ctes('fa', every)}, {scores('fa', every, 'sa')}
      SELECT model, {share('clean')} AS clean_detection_rate, {share('perturbed')} AS adversarial_detection_rate, {share('normal')} AS false_positive_rate FROM ({both}) GROUP BY model"""


def _importance_sql():
    variant = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, '{k}-' || id AS id, label, [{', '.join(f'o[{j}]' if j == k else f'x[{j}]' for j in range(1, len(FEATURES) + 1))}] AS x FROM lent" for k, name in enumerate(["(none)", *FEATURES])
    )
    judged = "(SELECT feature, label, CAST(score > (SELECT quantile_cont(score, 0.9) FROM s JOIN variants USING (id) WHERE feature = '(none)') AS INTEGER) AS predicted FROM s JOIN variants USING (id))"
    return f"""WITH {_TABLE}, placed AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) AS place, count(*) OVER () AS total FROM tbl),
      lent AS MATERIALIZED (SELECT a.id, a.label, a.x, b.x AS o FROM placed a JOIN placed b ON b.place = a.place % a.total + 1), variants AS MATERIALIZED ({variant}),
      {forest_ctes('f', _ALL)}, {scores('f', "SELECT '' AS grp, id, x FROM variants", 's')}, r AS ({rates_sql(counts_sql(judged, ['feature'], 'label'), ['feature'], None)})
      SELECT feature, f1, (SELECT f1 FROM r WHERE feature = '(none)') - f1 AS importance FROM r WHERE feature <> '(none)'"""


@query("ml06_grid_search", _search_sql(), ("features",))
def _(t):
    return forest.search(table(t), "row_id", "label", FEATURES)


@query("ml07_cross_validation", _folds_sql(), ("features",))
def _(t):
    _, summary = forest.cross_validate(table(t), "row_id", "label", FEATURES)
    return summary.select(*r6(*summary.columns))


@query("ml08_learning_curve", _curve_sql(), ("features",))
def _(t):
    return forest.learning_curve(table(t), "row_id", "label", FEATURES)


def augmented_training(t):
    """Detection of clean and perturbed attacks by a forest of normal rows and by one that has seen both."""
    df = cut_lineage(table(t))  # read by two forests, their row counts and their scores
    attack = df.filter("label = 1")
    perturbed = attack.withColumns({f: F.col(f) * 0.85 for f in WORN})
    before = forest_of(df.filter("label = 0"))
    after = cut_lineage(forest.fit_augmented([df.filter("label = 0"), attack, perturbed], "row_id", FEATURES))
    parts = df.filter("label = 0").withColumn("part", F.lit("normal")).unionByName(attack.withColumn("part", F.lit("clean"))).unionByName(perturbed.withColumn("part", F.lit("perturbed")))
    both = None
    for name, nodes in (("before", before), ("after", after)):
        scored = cut_lineage(forest.score(parts, nodes, FEATURES))
        one = forest.by_contamination(scored, "score", 0.1).withColumn("model", F.lit(name)).select("model", "part", "predicted")
        both = one if both is None else both.unionByName(one)
    return E.robustness(both, "model", "part", "predicted")


@query("ml09_augmented_training", _augmented_sql(), ("features",))
def _(t):
    return augmented_training(t)


@query(
    "evl22_perturbed_gain",
    f"""WITH rb AS ({_augmented_sql()}) SELECT round(a.adversarial_detection_rate - b.adversarial_detection_rate, 4) AS adversarial_robustness_gain, round(a.clean_detection_rate - b.clean_detection_rate, 4) AS clean_accuracy_delta,
          round(a.false_positive_rate - b.false_positive_rate, 4) AS fpr_delta FROM rb a, rb b WHERE a.model = 'after' AND b.model = 'before'""",
    ("features",),
)
def _(t):
    """The gain on rows that really are perturbed, judged again by both forests."""
    return E.robustness_gain(augmented_training(t))


@query(
    "evl22_perturbed_evasion",
    f"""WITH rb AS ({_augmented_sql()}) SELECT model, round(1 - clean_detection_rate, 3) AS pre_evasion_rate, round(1 - adversarial_detection_rate, 3) AS post_evasion_rate,
          round(clean_detection_rate - adversarial_detection_rate, 3) AS esr_delta FROM rb""",
    ("features",),
)
def _(t):
    return E.evasion_delta(augmented_training(t))


def encoded(t):
    """Encodings of three widths with a label, split into training and test rows."""
    e = t.read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    parts = [e.select("vec_id", "a"), e.select("vec_id", F.slice("a", 1, 32).alias("b")), e.select("vec_id", F.slice("a", 1, 16).alias("c"))]
    whole = lookups.concat_encodings(parts, "vec_id", ["a", "b", "c"], [64, 32, 16]).join(e.select("vec_id", (F.col("label") > 0).cast("int").alias("risk")), "vec_id")
    return cut_lineage(forest.stratified_split(whole, "vec_id"))


@query(
    "ml10_split",
    """SELECT risk, part, count(*) AS n FROM (SELECT CAST(label > 0 AS INTEGER) AS risk, CASE WHEN CAST('0x' || substr(md5(vec_id || '|42'), 1, 7) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS part
         FROM embeddings) GROUP BY ALL""",
)
def _(t):
    return encoded(t).groupBy("risk", "part").agg(F.count(F.lit(1)).alias("n"))


@query("ml10_risk_classifier")
def _(t):
    """Judged on rows the fit has not seen."""
    rows = encoded(t)
    model, _ = forest.risk_classifier(rows.filter("part = 'train'").drop("part"), "risk")
    return model.transform(forest.prepared_encodings(rows.filter("part = 'test'"))).groupBy("risk", F.col("prediction").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("ml11_permutation_importance", _importance_sql(), ("features",))
def _(t):
    df = cut_lineage(table(t))
    return forest.permutation_importance(df, "row_id", "label", FEATURES, forest_of(df))


@query(
    "ml12_run_registry",
    f"""SELECT detector || '/' || run AS params, round(f1, 6) AS f1, round(tpr, 6) AS tpr, 'evaluation' AS phase,
          (detector || '|' || run) = (SELECT arg_max(detector || '|' || run, (f1, detector || '|' || run)) FROM ({_RUNS})) AS best FROM ({_RUNS})""",
    ("verdicts",),
)
def _(t):
    long = E.stacked(t.judged.withColumn("run", F.col("user_id") % 10), DETECTORS, ["y_true", "run"])
    runs = E.rates(E.confusion(long, "y_true", "predicted", ["detector", "run"]), None)
    reg = forest.register_runs(runs, ["detector", "run"], ["f1", "tpr"], "evaluation", "f1")
    return reg.select(
        F.concat_ws("/", F.col("params")["detector"], F.col("params")["run"]).alias("params"), F.round(F.col("metrics")["f1"], 6).alias("f1"),
        F.round(F.col("metrics")["tpr"], 6).alias("tpr"), "phase", "best",
    )
