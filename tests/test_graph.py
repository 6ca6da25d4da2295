"""Walk co-occurrences and their factors against plain Python and dense linear algebra."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import graph, tiles


def dense(cells, names):
    at = {v: k for k, v in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in cells.collect():
        m[at[r.src], at[r.dst]] = r.weight
    return m


def test_co_occurrences(spark):
    walks = [list("abcab"), list("aaaa"), ["a"], list("abcdefg")]
    want = Counter()
    for w in walks:
        for i, a in enumerate(w):
            want.update((a, b) for j, b in enumerate(w) if i != j and abs(i - j) <= 2)
    df = spark.createDataFrame([(w,) for w in walks], "path array<string>")
    got = {(r.src, r.dst): r.n for r in graph.co_occurrences(df, 2).collect()}
    assert got == dict(want)
    cells = {(r.src, r.dst): r.weight for r in graph.positive_information(graph.co_occurrences(df, 2)).collect()}
    total = Counter()
    for (a, _), n in want.items():
        total[a] += n
    for (a, b), n in want.items():
        weight = np.log(n * sum(want.values()) / (total[a] * total[b]))
        assert cells.get((a, b), 0) == pytest.approx(max(weight, 0), abs=1e-12)


def test_factors_of_a_small_matrix_are_exact(spark):
    """Fewer vertices than columns: E E' is the absolute value of the matrix."""
    rng = np.random.default_rng(3)
    names = [f"v{k}" for k in range(20)]
    m = np.triu(rng.random((20, 20)) * (rng.random((20, 20)) < 0.4))
    m = m + m.T
    m[4] = m[:, 4] = 0  # no cells: not in the result
    cells = spark.createDataFrame([(names[i], names[j], float(m[i, j])) for i in range(20) for j in range(20) if m[i, j]], "src string, dst string, weight double")
    rows = {r.id: np.array(r.vector) for r in graph.spectral_embedding(cells, 64, rounds=3).collect()}
    assert set(rows) == set(names) - {"v4"} and all(len(v) == 64 for v in rows.values())
    keep = [n for n in names if n in rows]
    e = np.stack([rows[n] for n in keep])
    values, vectors = np.linalg.eigh(dense(cells, names))
    want = (vectors * np.abs(values)) @ vectors.T
    assert np.allclose(e @ e.T, want[np.ix_([names.index(n) for n in keep], [names.index(n) for n in keep])], atol=1e-8)


def test_neighbours_of_walk_embeddings(spark):
    """Four planted circles of 30 with chords, loosely joined: the nearest vertices are those of a dense decomposition."""
    rng = np.random.default_rng(5)
    links = []
    for c in range(4):
        for k in range(30):
            links += [(f"{c}-{k}", f"{c}-{(k + 1) % 30}"), (f"{c}-{k}", f"{c}-{rng.integers(30)}")]
        links.append((f"{c}-0", f"{(c + 1) % 4}-0"))
    edges = spark.createDataFrame(links, "src string, dst string")
    rows = {r.id: np.array(r.vector) for r in graph.walk_embeddings(edges, dim=8, walks=5, length=20).collect()}
    names = sorted(rows)
    assert len(names) == 120 and {len(v) for v in rows.values()} == {8}
    m = dense(graph.positive_information(graph.co_occurrences(graph.random_walks(edges, walks=5, length=20))), names)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    lead = np.argsort(-np.abs(values))[:8]
    want = vectors[:, lead] * np.sqrt(np.abs(values[lead]))

    def near(e):
        unit = e / np.linalg.norm(e, axis=1, keepdims=True)
        s = unit @ unit.T
        np.fill_diagonal(s, -2)
        return np.argsort(-s, axis=1)[:, :10]

    ours, theirs = near(np.stack([rows[n] for n in names])), near(want)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ours, theirs)]) > 0.9
    same = [names[j].split("-")[0] == n.split("-")[0] for n, js in zip(names, ours) for j in js]
    assert np.mean(same) > 0.95


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.walk_embeddings(none, dim=4, walks=2, length=3).count() == 0
    assert graph.co_occurrences(spark.createDataFrame([(["x"],)], "path array<string>")).count() == 0
    assert graph.walk_embeddings(none.union(spark.createDataFrame([("a", "b")], none.schema)), dim=4, walks=2, length=6).select(F.size("vector")).distinct().collect()[0][0] == 4


def test_tiles_of_any_size_give_the_same_factors(spark, monkeypatch):
    """Vectors meet the cells a tile at a time; no row of the job pairs a cell with a vector."""
    rng = np.random.default_rng(4)
    m = np.triu(rng.random((30, 30)) * (rng.random((30, 30)) < 0.3))
    m = m + m.T
    cells = spark.createDataFrame([(f"v{i}", f"v{j}", float(m[i, j])) for i in range(30) for j in range(30) if m[i, j]], "src string, dst string, weight double")
    found = []
    for block in (7, 1000):
        rows = {r.id: np.array(r.vector) for r in graph.spectral_embedding(cells, 8, rounds=2, block=block).collect()}
        e = np.stack([rows[n] for n in sorted(rows)])
        found.append(e @ e.T)
    assert np.allclose(*found, atol=1e-8)


def test_neighbour_means_combine_by_hash(spark):
    """Sums are plain aggregates, which do not fall back to sorting whole vectors."""
    edges = graph.both_directions(spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "src string, dst string"))
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 3.0])], "id string, vector array<double>")
    means = graph.neighbour_means(edges, vectors, hops=1, normalise=False)
    assert "ObjectHashAggregate" not in means._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.pos): r.value for r in means.collect()}
    assert got == {("a", 0): pytest.approx(2 / 3), ("a", 1): pytest.approx(1), ("b", 0): 0, ("b", 1): 3}
    assert graph.neighbour_means(edges, vectors.filter("false")).count() == 0


def test_numbered_walks_are_the_walks_and_nothing_is_left(spark, monkeypatch):
    """Walks in pieces of numbers, counted in several blocks and passes; what no later step reads is deleted."""
    import os

    monkeypatch.setattr(tiles.Grid.__init__, "__kwdefaults__", {"block": 10, "chunk": 3, "share": 2000, "most": 4000})
    rng = np.random.default_rng(6)
    links = [(f"a{i}", f"p{j}") for i in range(25) for j in rng.integers(0, 6, 4)] + [("a3", None), (None, "p1"), (None, None), ("a4", "a4")]
    edges = spark.createDataFrame(links, "src string, dst string")
    want = {(r.start, r.walk): r.path for r in graph.random_walks(edges, walks=3, length=14).collect()}
    ids, n, pieces, paths = graph.numbered_walks(edges, walks=3, length=14, seed=7, overlap=5)
    name = {r["at"]: r["id"] for r in ids.collect()}
    assert len(name) == n and len(want) < 3 * n  # some walks come to the neighbour without a name
    got = {}
    for rows, have, fresh in pieces:
        for r in rows.collect():
            assert len(r.path) == have
            got.setdefault((r.id, r.walk), []).extend(name[v] for v in r.path[have - fresh :])
    assert got == want
    folder = spark.conf.get("spark.checkpoint.dir")
    kept = lambda: {os.path.join(d, f) for d, _, files in os.walk(folder) for f in files}
    before = kept()
    found = graph.walk_embeddings(edges, dim=40, walks=3, length=14)  # more columns than vertices: the factors are exact
    rows = {r.id: np.array(r.vector) for r in found.collect()}
    left = {os.path.dirname(f) for f in kept() - before if os.path.basename(f).startswith("part-")}
    assert len(left) <= 5  # the numbers of the vertices and the last vectors, not every step and round
    pairs = graph.co_occurrences(graph.random_walks(edges, walks=3, length=14))
    names = sorted(r.src for r in pairs.select("src").distinct().collect())
    assert sorted(rows) == names
    m = dense(graph.positive_information(pairs), names)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    e = np.stack([rows[k] for k in names])
    assert np.allclose(e @ e.T, (vectors * np.abs(values)) @ vectors.T, atol=1e-8)


def test_a_block_of_rows_reads_all_vectors_in_one_task(spark, monkeypatch):
    """Neither vectors nor partial sums are shuffled in a product."""
    monkeypatch.setattr(tiles.Grid.__init__, "__kwdefaults__", {"block": 8, "chunk": 3, "share": 1 << 25, "most": 1 << 30})
    plans = []
    product = graph._product
    monkeypatch.setattr(graph, "_product", lambda *a: plans.append(product(*a)) or plans[-1])
    cells = spark.createDataFrame([(f"v{i}", f"v{j}", 1.0 + i * j) for i in range(30) for j in range(30) if (i + j) % 3], "src string, dst string, weight double")
    assert graph.spectral_embedding(cells, 4, rounds=1).count() == 30
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_no_vector_travels_along_an_edge(spark):
    """Vertices with two vectors, gaps in vectors, edges without a name; a hop shuffles nothing."""
    links = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "x"), ("c", None), ("c", "w"), ("d", "z"), ("x", "a"), ("y", "b"), ("y", "a")]
    edges = spark.createDataFrame(links, "src string, dst string")
    vectors = spark.createDataFrame([("x", [1.0, None]), ("x", [3.0, None]), ("y", [0.0, 3.0]), ("z", [2.0]), ("w", None), (None, [9.0, 9.0])], "id string, vector array<double>")
    once = graph.neighbour_means(edges, vectors, hops=1, normalise=False)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Join" not in plan
    got = {(r.id, r.pos): r.value for r in once.collect()}
    third = pytest.approx(3 / 5)
    assert got == {("a", 0): pytest.approx(8 / 5), ("a", 1): third, ("b", 0): 0, ("b", 1): 3, (None, 0): 2, (None, 1): None, ("d", 0): 2, ("d", 1): None}
    twice = {(r.id, r.pos): r.value for r in graph.neighbour_means(edges, vectors, hops=2, normalise=False).collect()}
    assert twice == {("x", 0): pytest.approx(8 / 5), ("x", 1): third, ("y", 0): pytest.approx(4 / 5), ("y", 1): pytest.approx(9 / 5)}
