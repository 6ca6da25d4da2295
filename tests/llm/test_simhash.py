import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewarden.llm import simhash
from tracewarden.llm.queries import op1


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    values = np.array(distinct, np.uint64)
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(distinct)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 3):
            parent[find(int(b))] = find(a)
    root = {p: find(k) for k, p in enumerate(distinct)}
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(op1(lambda t: docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(5, None), (3, ""), (7, " \t\n"), (9, "One"), (2, "one two"), (11, "ONE  two\n"), (4, base), (6, base.replace("w7 ", "w7x ")), (6, base), (None, base), (None, "alone here now"), (8, "é " * 50_000), (10, "a\x0bb\x1cc\x85d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("node", F.lit(1))
    assert got(simhash.near_duplicates(docs)) == brute(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [10, 2, 3, 4, 8, 9, None, None]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


@pytest.mark.parametrize("tile", [2, 2048])
def test_links_of_dense_group(spark, tile, monkeypatch):
    """Near prints beyond any tile, chained and dense: the same components as all pairs."""
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 2)).astype(np.uint64)
    prints = np.unique((seeds[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel())
    i, j = simhash.close_pairs(prints, prints, 3)
    x = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x))))
    node, root = simhash.forest(i, j, len(prints))
    want = np.arange(len(prints))
    for _ in range(len(prints)):
        new = np.where(x, want[None, :], len(prints)).min(1)
        if (new == want).all():
            break
        want = new
    have = np.arange(len(prints))
    have[node] = root
    assert (have == want).all()
    nodes = spark.createDataFrame([(int(p), k) for k, p in enumerate(prints.view(np.int64))], "fp long, node long")
    from tracewarden.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    assert [roots.get(k, k) for k in range(len(prints))] == want.tolist()


def test_rows_are_kept_by_content_not_by_id(spark):
    base = " ".join(f"w{k}" for k in range(400))
    other, third = " ".join(f"x{k}" for k in range(300)), " ".join(f"y{k}" for k in range(300))
    rows = [(1, other), (1, third), (3, base), (5, base.replace("w7 ", "w7x ")), (5, "a text of its own kind here"), (5, "a text of its own kind here"), *[(None, "no id and many copies of this")] * 50, (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, other), (1, third), (3, base), (5, "a text of its own kind here"), (None, "no id and many copies of this"), (None, None)], key=str)


def test_links_through_rows_without_an_id(spark, monkeypatch):
    prints = [(1, 0), (None, 0b111), (2, 0b111111), (None, 1 << 40 | 0xFFFF << 20)]
    fixed = spark.createDataFrame(prints, "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fixed)
    have = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(fixed).collect()), key=str)
    assert have == sorted([(1, 1), (None, 1), (2, 1), (None, None)], key=str)
