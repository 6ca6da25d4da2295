"""Model jobs on planted data."""

import random

from pyspark.sql import functions as F

from tracewarden.operators import forest, graph

COLS = ["a", "b", "c"]


def planted(spark, n=600, bad=30):
    rnd = random.Random(5)
    rows = [(i, 0, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(n)]
    rows += [(n + i, 1, rnd.gauss(9, 1), rnd.gauss(-9, 1), rnd.gauss(9, 1)) for i in range(bad)]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double").repartition(4)


def test_planted_outliers_rank_on_top_and_seeds_repeat(spark):
    df = planted(spark)
    nodes = forest.fit(df, "row_id", COLS, trees=40)
    scored = forest.score(df, nodes, COLS).collect()
    top = sorted(scored, key=lambda r: -r.score)[:30]
    assert sum(r.label for r in top) >= 28 and all(0 < r.score < 1 for r in scored)
    again = {r.row_id: r.score for r in forest.score(df.repartition(7), forest.fit(df.repartition(3), "row_id", COLS, trees=40), COLS).collect()}
    assert all(again[r.row_id] == r.score for r in scored)
    assert nodes.agg(F.max("sampled")).first()[0] <= forest.PSI and nodes.select("tree").distinct().count() == 40


def test_contamination_cut_flags_that_share(spark):
    df = planted(spark)
    flagged = forest.by_contamination(forest.score(df, forest.fit(df, "row_id", COLS, trees=30), COLS), "score", 0.05)
    assert 25 <= flagged.agg(F.sum("predicted")).first()[0] <= 33


def test_search_and_validation_find_the_planted_rows(spark):
    df = planted(spark)
    best = forest.search(df, "row_id", "label", COLS, trees=(20, 40), contamination=(0.05, 0.2), max_features=(1.0,)).first()
    assert best.contamination == 0.05 and best.f1 > 0.7
    folds, summary = forest.cross_validate(df, "row_id", "label", COLS, k=3, trees=20, contamination=0.05)
    row = summary.first()
    assert folds.count() == 3 and row.mean_f1 > 0.7 and row.f1_low <= row.mean_f1 <= row.f1_high
    curve = forest.learning_curve(df, "row_id", "label", COLS, sizes=(50, 100), trees=20, contamination=0.05).collect()
    assert [r["size"] for r in curve] == [50, 100]


def test_importance_finds_the_informative_feature(spark):
    df = planted(spark).withColumns({"b": F.lit(0.0), "c": F.lit(0.0)})
    out = forest.permutation_importance(df, "row_id", "label", COLS, forest.fit(df, "row_id", COLS, trees=20), contamination=0.05).collect()
    assert out[0].feature == "a" and out[0].importance > 0.5 and all(abs(r.importance) < 1e-9 for r in out[1:])


def test_split_keeps_class_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    parts = {(r.label, r.part): r.n for r in forest.stratified_split(df, "row_id").groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0, 1):
        assert abs(parts[(y, "test")] / (parts[(y, "test")] + parts[(y, "train")]) - 0.2) < 0.05


def test_walks_follow_edges(spark):
    edges = spark.createDataFrame([(f"h{i % 5}", f"d{(i * 7) % 11}") for i in range(40)], "src string, dst string")
    linked = {tuple(sorted((r.src, r.dst))) for r in edges.collect()}
    walks = graph.random_walks(edges, walks=2, length=6)
    rows = walks.collect()
    names = {x for e in linked for x in e}
    assert len(rows) == 2 * len(names) and all(len(r.path) == 6 and r.path[0] == r.start for r in rows)
    assert all(tuple(sorted(p)) in linked for r in rows for p in zip(r.path, r.path[1:], strict=False))


def test_sample_tree_follows_two_layers(spark):
    edges = spark.createDataFrame([("hub", f"v{i:03d}") for i in range(200)] + [(f"v{i:03d}", f"w{j}") for i in range(200) for j in range(i % 13)], "src string, dst string")
    linked = {(r.src, r.dst) for r in edges.collect()}
    rows = [r for r in graph.sample_tree(edges).collect() if r.root == "hub"]
    first = [r.path for r in rows if r.hop == 1]
    second = [r.path for r in rows if r.hop == 2]
    assert len(first) == 15 and len({tuple(p) for p in second}) == len(second)
    assert all(p in linked for path in first + second for p in zip(path, path[1:], strict=False))
    for _, v in first:
        assert sum(p[1] == v for p in second) == min(10, int(v[1:]) % 13)


def test_neighbour_means_of_a_small_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c")], "src string, dst string")
    vectors = spark.createDataFrame([("b", [3.0, 0.0]), ("c", [0.0, 3.0])], "id string, vector array<double>")
    got = {r.pos: r.value for r in graph.neighbour_means(edges, vectors, hops=1, normalise=False).collect()}
    assert got == {0: 1.0, 1: 2.0}


def test_small_tables_reach_every_tree(spark):
    for n in (1, 200, 700):
        df = planted(spark, n, 0)
        nodes = forest.fit(df, "row_id", COLS, trees=12)
        assert {r.sampled for r in nodes.select("sampled").distinct().collect()} == {min(n, forest.PSI)}
        assert nodes.select("tree").distinct().count() == 12


def test_student_quantiles_for_any_number_of_folds(spark):
    # printed tables of the distribution
    for freedom, value in ((1, 12.7062), (2, 4.3027), (9, 2.2622), (10, 2.2281), (30, 2.0423)):
        assert abs(forest.student_975(freedom) - value) < 1e-4
    folds = spark.createDataFrame([(0.5, 0.5, 0.5)], "f1 double, precision double, tpr double")
    assert forest.summarise_folds(folds, 1).first().f1_low is None


def test_full_walks_go_on_from_the_small_ones(spark):
    import __spark_entry__ as entry

    run = lambda name: {(r.start, r.walk): r.path.split(" ") for r in entry.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    small, full = run("gr04_random_walks"), run("gr04_random_walks_full")
    assert {k for _, k in full} == set(range(1, 11)) and all(len(p) == 40 for p in full.values())
    assert len(full) == 10 * len({s for s, _ in small})
    assert all(full[k][:10] == p for k, p in small.items())


def test_draws_are_those_of_md5_and_are_not_made_by_lambdas(spark):
    """The sample of every tree by plain Python; rows and trees never meet as structs of a row."""
    import hashlib

    rows = [(f"r{i}", float(i)) for i in range(500)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "row_id string, a double")
    seen = {}
    for i, (name, _) in enumerate(rows):
        digest = "".join(hashlib.md5("|".join(["42", *([] if name is None else [name]), "", str(k)]).encode()).hexdigest() for k in range(2))
        for tree in range(6):
            seen.setdefault(tree, []).append((digest[8 * tree : 8 * tree + 7], i))
    limit = -(-2**28 * 384 // 501)
    got = {}
    for batch in forest._sample(["a"], 6, 42)(iter([df.withColumnRenamed("row_id", "_id").withColumn("grp", F.lit("")).withColumn("_limit", F.lit(limit)).toPandas()])):
        for r in batch.to_dict("records"):
            got.setdefault(r["tree"], []).append((f"{r['u']:07x}", rows.index((r["_id"], r["a"]))))
    assert got == {t: sorted([d for d in x if int(d[0], 16) < limit], key=lambda d: d[1]) for t, x in seen.items()}
    assert "lambdafunction" not in forest.fit(df, "row_id", ["a"], trees=6)._jdf.queryExecution().toString()


def test_forests_read_a_finished_feature_table(spark, monkeypatch):
    import __spark_entry__ as entry

    fit, plans = forest.fit, []
    monkeypatch.setattr(forest, "fit", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or fit(df, *a, **k))
    for name in ("ml09_augmented_training", "ml11_permutation_importance"):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not [p for p in plans if "FileScan" in p]


def test_characters_of_features_go_by_blocks(spark):
    """Characters of any plane are counted exactly per address and window, in a row a block instead of one each."""
    import numpy as np

    from tracewarden.operators import features

    uris = ["/", "", None, "/é?x=1", "/" + "".join(chr(c) for c in range(0x21, 0x7F)), "/\U0001f600\U0001f600中", "/aab"]
    rows = [(i, 1_000_000 + i, ip, u) for ip in ("each", "all", None) for i, u in enumerate(uris)]
    rows = [(i, us + (i * 60_000_000 if ip == "each" else 0), ip, u) for i, us, ip, u in rows]
    log = spark.createDataFrame(rows, "event_id long, us long, remote_addr string, request_uri string").selectExpr(
        "*", "200 AS status", "0D AS request_time", "'-' AS http_user_agent", "10 AS body_bytes_sent", "'GET' AS request_method"
    )
    got = {(r.ip, r.bucket): r.f4_uri_char_entropy for r in features.behaviour_features(log, 60_000_000).collect()}

    def entropy(text):
        n = np.array([text.count(c) for c in set(text)], float)
        return float(-(n / n.sum() * np.log2(n / n.sum() + 1e-12)).sum()) if len(n) else 0.0

    texts = ["/" if u is None else u for u in uris]
    want = {("each", i): entropy(u) for i, u in enumerate(texts)} | {("all", 0): entropy("".join(texts))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    blocks = features.letter_blocks(log.select(F.coalesce("request_uri", F.lit("/")).alias("uri")), "uri").selectExpr("size(letters) AS n", "uri").collect()
    assert all(r.n == len({ord(c) // features.BLOCK for c in r.uri}) for r in blocks)
