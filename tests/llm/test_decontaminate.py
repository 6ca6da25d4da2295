import re

import numpy as np
from pyspark.sql import functions as F

from tracewarden.llm import decontaminate
from tracewarden.llm.fm_index import FmIndex, suffix_order
from tracewarden.llm.queries import op7
from tests.llm.brute import digest


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    for i, t in docs:
        w = words_of(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        yield i, len(w), len(hit), len(found), digest(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_suffix_order_and_index():
    rng = np.random.default_rng(3)
    for size in (2, 3, 9):
        for n in (1, 2, 50, 700):
            s = rng.integers(0, size, n)
            s[-1] = 0
            if n == 700:
                s[100:400] = s[400:700]
            ends = np.cumsum(s == 0)
            key = lambda k, s=s, ends=ends: [(int(x), int(e) if x == 0 else 0) for x, e in zip(s[k:], ends[k:])]
            assert suffix_order(s).tolist() == sorted(range(len(s)), key=key)
            index = FmIndex(s, size)
            for length in (1, 2, 5):
                pattern = rng.integers(1, size, (30, 6))
                low, high = index.search(pattern, np.full(30, length))
                for p, a, b in zip(pattern, low, high):
                    want = [k for k in range(len(s) - length + 1) if (s[k : k + length] == p[6 - length :]).all()]
                    assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_whole_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    want = brute([(r.doc_id, r.text) for r in read("documents").collect()], [(r.item_id, r.text) for r in read("benchmark").collect()])
    got = rows(op7(read))
    assert got == sorted(want, key=str)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def edge_tables(spark):
    a = " ".join(f"a{k}" for k in range(20))
    items = [(1, a), (2, "short é item"), (3, None), (4, "  .. "), (10, a.upper()), (None, "x"), (5, "rep rep rep"), (1, a)]
    docs = [(1, a), (1, a), (2, None), (3, ""), (4, f"Short, É? item {a[:-3]} end"), (5, "short É item x"), (6, "rep " * 40), (7, "z " * 3000 + a + " z" * 3000), (None, "X"), (8, "b " * 100_000), (9, "!!"), (11, "shortéitem")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("spans", F.lit(None).cast("int")),
        spark.createDataFrame(items, "item_id long, text string"), docs, items,
    )


def test_edges(spark, monkeypatch):
    docs, tests, d, i = edge_tables(spark)
    for portion in (4 << 20, 90):
        monkeypatch.setattr(decontaminate, "PORTION", portion)
        assert rows(op7({"documents": docs, "benchmark": tests}.get)) == sorted(brute(d, i), key=str)


def test_clean(spark):
    docs, tests, d, i = edge_tables(spark)
    out = decontaminate.clean(docs.withColumn("n_chars", F.length("text")), tests)
    assert out.columns == [*docs.columns, "n_chars"]
    left = {r.doc_id: r for r in out.collect()}
    assert set(left) == {2, 3, 7, 8, 9, 11}
    assert left[7].text == "z " * 3000 + " z" * 3000 and left[7].n_chars == 12_000
    assert left[8].text == "b " * 100_000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tests = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert op7({"documents": docs, "benchmark": tests}.get).collect() == []
    assert rows(op7({"documents": some, "benchmark": tests}.get)) == sorted(brute([(1, "a b")], []))
