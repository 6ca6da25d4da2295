import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import bit_filter, collocations
from tracewarden.llm.collocations import _exact_score


def brute(docs, support=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        frequent = {p: c for (x, p), c in f.items() if x == lang and c >= support}
        rows = []
        for p, a in frequent.items():
            if len(p) < 2 or any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in frequent.items() if len(p) == 2):
                continue
            score, _, left, right = min((10**6 * a * a // (frequent[p[:k]] * frequent[p[k:]]), k, frequent[p[:k]], frequent[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
        out += [(lang, rank, p, -a, left, right, n[lang], -score) for rank, (score, a, _, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def made(rng):
    word = lambda: f"W{int(rng.paretovariate(0.9))}"
    fixed = ["New York city", "de facto", "São Paulo état", "x x x x", "a b c"]
    docs = []
    for k in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else word() for _ in range(rng.randrange(0, 40))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ", ", "\n", ".", "; "]) for p in parts)
        docs.append((rng.choice(["en", "de", None, "", "tiny"] if k % 7 else ["en"]), text))
    return docs + [docs[0]] * 20 + [("fr", None), ("fr", ""), (None, "one"), ("long", "over and " * 30_000), ("dots", ",.;" * 1000)]


@pytest.mark.parametrize("combine", [1 << 21, 50])
def test_brute_force(spark, monkeypatch, combine):
    monkeypatch.setattr(collocations, "COMBINE", combine)
    docs = made(random.Random(combine))
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("shard", F.lit("x")).withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)).repartition(4)
    found = collocations.collocations(df)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(docs)
    assert rows(found) == want and {r[0] for r in want} >= {"en", "und", "long"}
    assert rows(collocations.collocations(df, support=3, top=4)) == brute(docs, 3, 4)


def test_small_bit_fields_and_unknown_shards(spark, monkeypatch):
    """A full bit field and shards whose support the tasks do not know only add candidates."""
    monkeypatch.setattr(bit_filter, "MOST", 64)
    monkeypatch.setattr(bit_filter, "LEAST", 64)
    monkeypatch.setattr(collocations, "KNOWN", 1)
    docs = made(random.Random(3))
    df = spark.createDataFrame([(b, a) for a, b in docs], "`te.xt` string, `l g` string")
    assert rows(collocations.collocations(df, text_col="te.xt", lang_col="l g")) == brute(docs)


def test_local_support_misses_nothing(spark):
    """Shards mined at their share of the support find every frequent phrase; those that they miss are infrequent."""
    docs = made(random.Random(9))
    counted = collocations.phrase_counts(spark.createDataFrame(docs, "lang string, text string"), 10).where("size > 0")
    f = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update(("und" if lang is None else lang, k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    assert rows(counted) == sorted((*k, c) for k, c in f.items() if c >= 10)


def test_score_beyond_64_bits(spark):
    cases = [(10**12, 10**12, 10**12 + 7), (999_999_999_999, 10**13, 10**12), (10, 10, 10), (10**15, 10**16, 3 * 10**15), (7, 9, 11)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [r[0] for r in df.select(_exact_score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (left * right) for a, left, right in cases]


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(collocations.collocations(docs)) == brute([(r.lang, r.text) for r in docs.collect()])
    assert np.all(np.diff([r.rank for r in collocations.collocations(docs).where("lang = 'en'").orderBy("rank").collect()]) == 1)
