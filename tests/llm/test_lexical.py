import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracewarden.llm import lexical
from tracewarden.llm.queries import op13


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in queries.items():
        found = []
        for (i, c), n in zip(counts, sizes):
            if n:
                m = 50 + 50 * n * n_docs // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
                found += [(-score, i is None, i if i is not None else 0, i)] if score > 0 else []
        out += [(item, rank, f[-1], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edge_tables(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for k in range(600)]
    docs += [(700, "same text rare1"), (699, "same text rare1"), (698, "SAME, text: rare1!")] + [(701 + k, "copy copy w1") for k in range(120)]
    docs += [(None, "same text rare1"), (None, None), (3, ""), (3, "?!"), (900, "é Éa größe 日本 ascii" + " pad" * 20_000), (901, "x " * 100_000 + "rare1"), (700, "same text rare1")]
    items = [(1, "same RARE1"), (2, "w1 w2 w3 w5 w8 w13 w21 w40 w99"), (3, None), (4, ""), (None, "größe 日本"), (5, "absent words"), (6, "copy w1"), (6, "x"), (6, "x"), (7, "w1 w1 w1 w2"), (8, "É é Éa")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_whole_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    docs, items = ([tuple(r) for r in read(t).select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(op13(read)) == brute(docs, items)


def test_edges_shards_and_portions(spark, monkeypatch):
    docs, items, d, i = edge_tables(spark)
    clash = d.withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    want = brute(docs, items)
    for shard, portion in ((4 << 20, 4 << 20), (700, 40)):
        monkeypatch.setattr(lexical, "SHARD", shard)
        monkeypatch.setattr(lexical, "PORTION", portion)
        assert rows(lexical.search(clash.repartition(3), i.withColumn("term", F.lit(1)))) == want
    assert rows(lexical.search(d, i, k=3)) == brute(docs, items, 3)


def test_string_ids_and_names(spark):
    docs, items, d, i = edge_tables(spark)
    key = lambda x: None if x is None else f"n{x:05d}"
    named = d.select(F.concat(F.lit("n"), F.lpad("doc_id", 5, "0")).alias("a b"), F.col("text").alias("te.xt"))
    found = lexical.search(named, i.select(F.col("item_id").cast("string").alias("q"), "text"), id_col="a b", text_col="te.xt", item_col="q")
    assert found.columns == ["q", "rank", "a b", "score"]
    want = brute([(key(k), t) for k, t in docs], [(None if k is None else str(k), t) for k, t in items])
    # a null id sorts behind all strings in brute() too, where it counts as 0 among nulls only
    assert rows(found) == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    for docs, queries in ((none, items), (some, items.where("false")), (blank, items), (none, items.where("false"))):
        found = lexical.search(docs, queries)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_accumulators_stop_and_survivors_stay_exact():
    """Common terms make no accumulator once they cannot lift a document into the result; scores are those of all terms."""
    rng = np.random.default_rng(2)
    size, k = 2000, 5
    rare, common = rng.choice(size, 40, replace=False), rng.choice(size, 1500, replace=False)
    lists = [(np.sort(rare), rng.integers(900, 1000, 40)), (np.sort(common), rng.integers(1, 100, 1500))]
    full = np.zeros(size, np.int64)
    for doc, gain in lists:
        full[doc] += gain
    ranker = lexical.Ranker(lexical.Queries([], np.zeros(0, np.uint64), []), np.zeros(0, np.int64), 1, 1, k)
    left = np.array([int(lists[0][1].max() + lists[1][1].max()), int(lists[1][1].max())])
    score = ranker.accumulate(size, lists, left, 1)
    assert set(np.flatnonzero(score)) == set(rare.tolist())
    assert (score[rare] == full[rare]).all()
    assert (ranker.accumulate(size, lists, np.array([2000, 1000]), 1) == full).all()
