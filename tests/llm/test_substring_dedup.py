import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import digest
from tracewarden.llm import bit_filter, substring_dedup
from tracewarden.llm.matching import MatchIndex
from tracewarden.llm.queries import op12


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, window=20):
    """``docs`` in document order."""
    seen, out = {}, []
    for i, t in docs:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone |= set(range(p, p + window))
            seen.setdefault(key, (i, p))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def texts(rng, many):
    word = lambda: f"w{rng.randrange(60)}"
    passages = [[f"p{k}_{j}" for j in range(rng.randrange(15, 90))] for k in range(6)] + [["b"] * 70, [f"z{j % 3}" for j in range(60)]]
    out = []
    for _ in range(many):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [word() for _ in range(rng.randrange(0, 40))]
            p = rng.choice(passages)
            lo = rng.randrange(len(p))
            w += p[lo : lo + rng.randrange(1, 80)] if rng.random() < 0.5 else p
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return out + [out[0]] * 5 + out[:10]


def test_matching_statistics():
    rng = np.random.default_rng(4)
    for size, n, cap in ((3, 60, 5), (4, 300, 8), (2, 40, 20), (30, 500, 4)):
        text = rng.integers(0, size, n)
        text[-1] = 0
        text[n // 2 : n // 2 + n // 4] = text[: n // 4]
        index = MatchIndex(text, size, cap)
        stream = rng.integers(-1, size, 200)
        stream[:100] = text[:100] if n >= 100 else stream[:100]
        begin, length = np.array([0, 50, 50, 120, 199]), np.array([50, 0, 60, 79, 1])
        long, low, high = index.statistics(stream, begin, length)
        joined = [tuple(text[k : k + cap].tolist()) for k in range(n)]
        for b, m in ((0, 50), (120, 79), (199, 1)):
            for p in range(b, b + m):
                want = 0
                for d in range(1, min(cap, b + m - p) + 1):
                    part = tuple(stream[p : p + d].tolist())
                    if min(part) < 1 or not any(j[:d] == part for j in joined):
                        break
                    want = d
                assert long[p] == want, (size, p)
                part = tuple(stream[p : p + want].tolist())
                if want:
                    assert high[p] - low[p] == sum(j[:want] == part for j in joined)


@pytest.mark.parametrize("chunk,hot", [(1 << 19, 4096), (300, 5)])
def test_brute_force(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "RUN", 16)
    docs = list(enumerate(texts(random.Random(chunk), 250)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("mark", F.lit(1)).withColumn("spans", F.lit("x")).repartition(5)
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(df).collect())
    assert got == brute(docs)
    if chunk == 300:
        got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(df, window=4).collect())
        assert got == brute(docs, 4)


def test_whole_table(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    docs = sorted((r.doc_id, r.text) for r in read("documents").collect())
    assert rows(op12(read)) == [(i, n, gone, digest(kept)) for i, n, gone, kept in brute(docs)]


def test_edges(spark):
    a = " ".join(f"a{k}" for k in range(25))
    docs = [(1, None), (2, ""), (3, a), (4, a.upper()), (4, a.replace(" ", "\n\n")), (5, "x " + a + " é 日本"), (5, "x " + a + " é 日本"), (6, "b " * 60_000), (7, "b " * 19), (8, " " + "b " * 20), (None, a), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.row.doc_id is None, r.row.doc_id or 0, r.row.text or "", r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(df).collect()))
    by = {(i, t): (n, gone, kept) for _, i, t, n, gone, kept in got}
    assert len(got) == len(docs)
    assert by[1, ""] == by[2, ""] == (0, 0, "")
    assert by[3, a] == (25, 0, a) and by[4, a.upper()] == (25, 0, a.upper())
    assert by[4, a.replace(" ", "\n\n")] == (25, 25, "")
    assert by[5, "x " + a + " é 日本"] == (28, 25, "x é 日本")  # a repeated row is the same document
    assert by[6, "b " * 60_000] == (60_000, 59_999, "b")
    assert by[7, "b " * 19][1] == 0 and by[8, " " + "b " * 20] == (20, 20, "")
    assert by[0, a] == (25, 25, "")
    assert substring_dedup.dedup(df.where("false")).collect() == []
    strings = spark.createDataFrame([("b", a), ("a", a + " z")], "key string, body string")
    assert {r.row.key: r.kept for r in substring_dedup.dedup(strings, id_col="key", text_col="body").collect()} == {"a": a + " z", "b": ""}


def test_bit_filter(spark, monkeypatch):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    members = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    field = bit_filter.bit_filter(keys, "k")
    assert field.has(members).all() and field.has(others).mean() < 0.05
    monkeypatch.setattr(bit_filter, "MOST", bit_filter.LEAST)
    monkeypatch.setattr(bit_filter, "LEAST", 1024)
    full = bit_filter.bit_filter(keys, "k")
    assert len(full.words) * 64 <= 1 << 17 and full.has(members).all()
    assert not bit_filter.bit_filter(keys.where("false"), "k").has(others).any()
