"""Isolation forests as Spark jobs: sampled growth per tree, vectorised scoring, search and validation.

Growing a tree needs at most ``PSI`` rows, so the data is reduced to ``trees * PSI`` sampled rows before
anything is grouped.  A forest is a node table of at most ``2 * PSI - 1`` rows per tree, small enough to
ship to every task by construction.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.operators import evaluation
from tracewarden.operators.graph import stable_hash
from tracewarden.operators.scale import exact_quantiles, prefix_sums
from tracewarden.session import cut_lineage

PSI = 256  # rows per tree
DEPTH = 8  # ceil(log2(PSI))
OVERSAMPLE = 1.5
DRAWS = 1 << 28  # numbers that seven hexadecimal digits can name
# Search grid.
GRID_TREES = (50, 100, 150, 200)
GRID_CONTAMINATION = (0.05, 0.10, 0.15, 0.20)
GRID_MAX_FEATURES = (0.5, 0.75, 1.0)
NODES = "grp string, tree int, node int, feature int, threshold double, child int, size int, sampled int"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _draw(*parts) -> str:
    """Hexadecimal digits drawn for a name; any engine with MD5 draws the same."""
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def _grow(features: Sequence[str], max_features: float, seed: int):
    """Nodes of one tree, numbered like a heap: the children of n are 2n + 1 and 2n + 2."""
    width = max(1, int(round(max_features * len(features))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp, tree = str(pdf["grp"].iloc[0]), int(pdf["tree"].iloc[0])
        x = pdf[list(features)].to_numpy(float)
        usable = sorted(sorted(range(len(features)), key=lambda f: _draw(seed, tree, f))[:width])
        rows, queue = [], [(0, np.arange(len(x)), 0)]
        while queue:
            node, idx, depth = queue.pop()
            part = x[idx][:, usable]
            lo, hi = part.min(axis=0), part.max(axis=0)
            varied = np.flatnonzero(hi > lo)
            if depth >= DEPTH or len(idx) <= 1 or len(varied) == 0:
                rows.append((grp, tree, node, -1, 0.0, -1, len(idx), len(x)))
                continue
            drawn = _draw(seed, grp, tree, node)
            pick = varied[int(drawn[:7], 16) % len(varied)]
            cut = lo[pick] + int(drawn[7:14], 16) / DRAWS * (hi[pick] - lo[pick])
            if not lo[pick] < cut <= hi[pick]:
                cut = hi[pick]
            left = part[:, pick] < cut
            rows.append((grp, tree, node, int(usable[pick]), float(cut), 2 * node + 1, len(idx), len(x)))
            queue += [(2 * node + 1, idx[left], depth + 1), (2 * node + 2, idx[~left], depth + 1)]
        return pd.DataFrame(rows, columns=["grp", "tree", "node", "feature", "threshold", "child", "size", "sampled"])

    return run


def _sample(features: Sequence[str], trees: int, seed: int):
    """Rows under the trees for which they draw a number below their limit: the first seven of each eight digits."""
    words = [str(k).encode() for k in range((trees + 3) // 4)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests = []
            for name, grp in zip(b["_id"], b["grp"], strict=True):
                begun = hashlib.md5("|".join([str(seed), *([] if name is None else [name]), grp, ""]).encode())
                for k in words:
                    h = begun.copy()
                    h.update(k)
                    digests.append(h.digest())
            u = np.frombuffer(b"".join(digests), ">u4").reshape(len(b), -1)[:, :trees] >> 4
            row, tree = np.nonzero(u < b["_limit"].to_numpy()[:, None])
            hit = b.iloc[row]
            yield pd.DataFrame({"grp": hit["grp"], "tree": tree.astype(np.int32), "u": u[row, tree].astype(np.int64), "_id": hit["_id"], **{f: hit[f] for f in features}})

    return run


def fit(df: DataFrame, id_column: str, features: Sequence[str], *, trees: int = 100, max_features: float = 1.0, seed: int = 42, group: str | None = None) -> DataFrame:
    """Node table of one forest, or of one forest per value of ``group`` (a few values: their row counts are a map).

    A tree sees the ``PSI`` rows that draw the smallest numbers for it, or all if there are fewer.  Every row draws a
    number a tree, four from one hash, and only goes to trees for which it is below the share at which about ``PSI *
    OVERSAMPLE`` rows come: only those leave the task that drew them.  The same seed gives the same forest in any engine.
    """
    keyed = df.select(F.col(id_column).cast("string").alias("_id"), (F.col(group) if group else F.lit("")).cast("string").alias("grp"), *[F.col(f).cast("double").alias(f) for f in features])
    counts = keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("grp").isNotNull())
    sizes = counts.agg(F.map_from_entries(F.collect_list(F.struct("grp", "n")))).scalar()
    share = F.lit(PSI * OVERSAMPLE) / F.element_at(sizes, F.col("grp"))
    rows = keyed.filter(F.col("grp").isNotNull()).withColumn("_limit", F.when(share >= 1, F.lit(DRAWS)).otherwise(F.ceil(share * DRAWS).cast("long")))
    shape = "grp string, tree int, u long, _id string, " + ", ".join(f"`{f}` double" for f in features)
    drawn = rows.mapInPandas(_sample(features, trees, seed), shape)
    # about PSI * OVERSAMPLE rows per tree reach this window
    order = Window.partitionBy("grp", "tree").orderBy("u", "_id")
    sample = drawn.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= PSI)
    return sample.select("grp", "tree", "_id", *features).groupBy("grp", "tree").applyInPandas(_grow(features, max_features, seed), NODES)


class _Forest:
    """Node table as arrays; kept per task, built from the shipped table."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        for _, n in nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
            number, feature = n["node"].to_numpy(np.int64), n["feature"].to_numpy(np.int64)
            leaf = feature < 0
            # siblings stand side by side; a leaf leads to itself, as nothing is at least NaN
            child = np.where(leaf, np.arange(len(n)), np.searchsorted(number, n["child"].to_numpy()))
            end = np.floor(np.log2(number + 1)) + np.array([average_path(s) for s in n["size"]])
            self.trees.append((np.where(leaf, 0, feature), np.where(leaf, np.nan, n["threshold"].to_numpy()), child, end))
        self.norm = average_path(float(nodes["sampled"].max()))

    def depths(self, x: np.ndarray) -> np.ndarray:
        """Path length of every row in every tree."""
        out = np.empty((len(self.trees), len(x)))
        first = np.arange(len(x)) * x.shape[1]
        flat = np.ascontiguousarray(x).ravel()
        for t, (feature, cut, child, end) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = child.take(at) + (flat.take(first + feature.take(at)) >= cut.take(at))
            out[t] = end.take(at)
        return np.ascontiguousarray(out.T)


def score(df: DataFrame, nodes: DataFrame, features: Sequence[str], *, prefixes: Sequence[int] | None = None, group: str | None = None) -> DataFrame:
    """Append anomaly scores in (0, 1): ``score``, or ``score_<n>`` over the first ``n`` trees.

    Rows with a ``group`` are scored by that group's forest.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(nodes.toPandas())  # at most groups * trees * (2 * PSI - 1) rows
    names = ["score"] if prefixes is None else [f"score_{p}" for p in prefixes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forests = {str(g): _Forest(n) for g, n in table.value.groupby("grp")}
        for b in batches:
            out = {n: np.full(len(b), np.nan) for n in names}
            owner = b[group].astype(str).to_numpy() if group else np.full(len(b), "")
            for g, forest in forests.items():
                mine = np.flatnonzero(owner == g)
                if len(mine):
                    d = forest.depths(b[list(features)].to_numpy(float)[mine])
                    for n, p in zip(names, prefixes or [d.shape[1]], strict=True):
                        out[n][mine] = 2.0 ** (-d[:, :p].mean(axis=1) / forest.norm)
            yield b.assign(**out)

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return df.mapInPandas(run, schema)


def by_contamination(df: DataFrame, score_column: str, contamination: float) -> DataFrame:
    """Flag the most anomalous share: scores above the (1 - contamination) quantile."""
    cut = exact_quantiles(df, [], score_column, [1 - contamination]).select("quantile").scalar()
    return df.withColumn("_cut", cut).withColumn("predicted", (F.col(score_column) > F.col("_cut")).cast("int")).drop("_cut")


def stratified_split(df: DataFrame, id_column: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Replayable split: the hash of the id decides, so every class is cut in the same proportion."""
    return df.withColumn("part", F.when(stable_hash(id_column, seed=seed) % 100 < test_percent, "test").otherwise("train"))


def search(df: DataFrame, id_column: str, label: str, features: Sequence[str], *, seed: int = 42, trees=GRID_TREES, contamination=GRID_CONTAMINATION, max_features=GRID_MAX_FEATURES) -> DataFrame:
    """F1 on the test part of every combination, best first.

    One forest per ``max_features`` is grown on the training part; smaller forests are its prefixes and
    contamination levels are cuts of the training scores, so 48 settings need three forests.
    """
    split = cut_lineage(stratified_split(df.select(id_column, label, *features), id_column, seed=seed))
    long = None
    for m in max_features:
        nodes = fit(split.filter("part = 'train'"), id_column, features, trees=max(trees), max_features=m, seed=seed)
        scored = score(split, nodes, features, prefixes=trees)
        cells = F.array(*[F.struct(F.lit(m).alias("max_features"), F.lit(n).alias("trees"), F.col(f"score_{n}").alias("score")) for n in trees])
        part = scored.select("part", label, F.explode(cells).alias("c")).select("part", label, "c.*")
        long = part if long is None else long.unionByName(part)
    long = cut_lineage(long)
    keys = ["max_features", "trees"]
    cuts = exact_quantiles(long.filter("part = 'train'"), keys, "score", [1 - c for c in contamination])
    judged = long.filter("part = 'test'").join(cuts, keys).withColumns(
        {"contamination": F.round(1 - F.col("prob"), 4), "predicted": (F.col("score") > F.col("quantile")).cast("int")}
    )
    out = evaluation.rates(evaluation.confusion(judged, label, "predicted", [*keys, "contamination"]))
    return out.orderBy(F.desc("f1"), "max_features", "trees", "contamination")


def _cut_map(cuts: DataFrame, key: str):
    """The cuts of a few forests as one scalar map."""
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct(key, "quantile")))).scalar()


def cross_validate(df: DataFrame, id_column: str, label: str, features: Sequence[str], *, k: int = 5, trees: int = 100, contamination: float = 0.1, max_features: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Per-fold metrics and their summary with a t interval.  All fold forests grow in one job."""
    folded = cut_lineage(df.select(id_column, label, *features).withColumn("fold", stable_hash(id_column, seed=seed) % k))
    others = folded.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(F.col("held") != F.col("fold"))
    nodes = fit(others, id_column, features, trees=trees, max_features=max_features, seed=seed, group="held")
    # each forest also scores its training rows, whose quantile is the cut
    scored = cut_lineage(score(folded.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))), nodes, features, group="held"))
    cuts = exact_quantiles(scored.filter("held <> fold"), ["held"], "score", [1 - contamination])
    judged = scored.filter("held = fold").withColumn("predicted", (F.col("score") > F.element_at(_cut_map(cuts, "held"), F.col("held"))).cast("int"))
    folds = evaluation.rates(evaluation.confusion(judged, label, "predicted", ["fold"]))
    return folds, summarise_folds(folds, k)


def student_975(freedom: int) -> float:
    """97.5 % quantile of Student's t: bisection on its density, integrated by Simpson's rule."""
    scale = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)
    steps = 2000

    def below(x: float) -> float:
        # with u = x / sqrt(f) * tan the integral is over an angle and smooth for any degree of freedom
        top = math.atan(x / math.sqrt(freedom))
        weight = lambda i: 1 if i in (0, steps) else 4 if i % 2 else 2
        total = sum(weight(i) * math.cos(top * i / steps) ** (freedom - 1) for i in range(steps + 1))
        return 0.5 + scale * math.sqrt(freedom) * total * top / steps / 3

    low, high = 0.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < 0.975 else (low, middle)
    return high


def summarise_folds(folds: DataFrame, k: int) -> DataFrame:
    """Means over the folds with a t interval; a single fold has none."""
    row = folds.agg(F.avg("f1").alias("mean_f1"), F.stddev_samp("f1").alias("std_f1"), F.avg("precision").alias("mean_precision"), F.avg("tpr").alias("mean_recall"))
    margin = F.lit(student_975(k - 1) if k > 1 else None).cast("double") * F.col("std_f1") / math.sqrt(k)
    return row.withColumns({"f1_low": F.col("mean_f1") - margin, "f1_high": F.col("mean_f1") + margin})


def learning_curve(df: DataFrame, id_column: str, label: str, features: Sequence[str], *, sizes: Sequence[int] = (20, 40, 60, 80, 100), trees: int = 100, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """F1 on the test part by the percentage of training rows used; the samples are nested."""
    split = cut_lineage(
        stratified_split(df.select(id_column, label, *features), id_column, seed=seed).withColumn("_u", stable_hash(id_column, seed=seed + 1) % 100)
    )
    grown = split.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    train = (F.col("part") == "train") & (F.col("_u") < F.col("size"))
    nodes = fit(grown.filter(train), id_column, features, trees=trees, seed=seed, group="size")
    scored = cut_lineage(score(grown.filter(train | (F.col("part") == "test")), nodes, features, group="size"))
    cuts = exact_quantiles(scored.filter("part = 'train'"), ["size"], "score", [1 - contamination])
    judged = scored.filter("part = 'test'").withColumn("predicted", (F.col("score") > F.element_at(_cut_map(cuts, "size"), F.col("size"))).cast("int"))
    return evaluation.rates(evaluation.confusion(judged, label, "predicted", ["size"])).orderBy("size")


def fit_augmented(parts: Sequence[DataFrame], id_column: str, features: Sequence[str], **settings) -> DataFrame:
    """Train on the union of normal, attack and perturbed rows; ids are made unique per part."""
    stacked = None
    for i, p in enumerate(parts):
        one = p.select(F.concat(F.lit(f"{i}-"), F.col(id_column).cast("string")).alias("_row"), *features)
        stacked = one if stacked is None else stacked.unionByName(one)
    return fit(stacked, "_row", features, **settings)


def permutation_importance(df: DataFrame, id_column: str, label: str, features: Sequence[str], nodes: DataFrame, *, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Loss of F1 when one feature is replaced by the value of another row.

    Rows stand in one seeded random order and everyone borrows from the next; the ordering and the join
    are done once for all features.
    """
    base = df.select(id_column, label, *features).withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string")).cast("binary")))
    placed = cut_lineage(prefix_sums(base, [], ["_h", id_column], {"_at": F.lit(1)}))
    total = placed.agg(F.max("_at")).scalar()
    lent = placed.select((F.col("_at") - 1).alias("_to"), *[F.col(f).alias(f"_o_{f}") for f in features]).withColumn(
        "_to", F.when(F.col("_to") == 0, total).otherwise(F.col("_to"))
    )
    both = placed.join(lent, placed["_at"] == lent["_to"])
    plans = ["(none)", *features]
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("feature"), *[(F.col(f"_o_{f}") if f == p else F.col(f)).cast("double").alias(f) for f in features])
            for p in plans
        ]
    )
    variants = both.select(label, F.explode(cells).alias("v")).select(label, "v.*")
    scored = cut_lineage(score(variants, nodes, features))
    cut = exact_quantiles(scored.filter("feature = '(none)'"), [], "score", [1 - contamination]).select("quantile").scalar()
    judged = scored.withColumn("_cut", cut).withColumn("predicted", (F.col("score") > F.col("_cut")).cast("int"))
    f1 = cut_lineage(evaluation.rates(evaluation.confusion(judged, label, "predicted", ["feature"]), None).select("feature", "f1"))
    whole = f1.filter("feature = '(none)'").select("f1").scalar()
    return f1.filter("feature <> '(none)'").withColumn("importance", whole - F.col("f1")).orderBy(F.desc("importance"), "feature")


def prepared_encodings(encodings: DataFrame) -> DataFrame:
    """Encodings as the vectors that the classifier of risk reads."""
    from pyspark.ml.functions import array_to_vector

    return encodings.withColumn("raw", array_to_vector("encoding"))


def risk_classifier(encodings: DataFrame, label: str, *, width: int = 112, layers: Sequence[int] = (64, 32), seed: int = 42, iterations: int = 30):
    """Scaled encodings through a small perceptron; returns the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    prepared = prepared_encodings(encodings)
    stages = [
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[width, *layers, 2], seed=seed, maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(prepared), prepared


def register_runs(runs: DataFrame, params: Sequence[str], metrics: Sequence[str], phase: str, best_by: str) -> DataFrame:
    """Runs as rows of the registry: parameter and metric maps, phase, and a flag on the best run."""
    as_map = lambda cols, t: F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast(t))])
    rows = runs.withColumns({"params": as_map(params, "string"), "metrics": as_map(metrics, "double"), "phase": F.lit(phase)})
    best = runs.agg(F.max(F.struct(F.col(best_by), F.concat_ws("|", *[F.col(p).cast("string") for p in params]).alias("key")))).scalar()
    return rows.withColumn("_b", best).withColumn("best", F.concat_ws("|", *[F.col(p).cast("string") for p in params]) == F.col("_b.key")).select(
        "params", "metrics", "phase", "best"
    )
