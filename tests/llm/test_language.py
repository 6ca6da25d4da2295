import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewarden.llm import language
from tracewarden.llm.byte_text import blocks
from tracewarden.llm.queries import op3


def brute_bits(train, text):
    """PPM by dictionaries: one language, contexts of up to ORDER bytes, escape method C."""
    seen = defaultdict(Counter)
    fold = lambda t: b"\n" * language.ORDER + bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    for t in train:
        raw = fold(t)
        for i in range(language.ORDER, len(raw)):
            for k in range(language.ORDER + 1):
                seen[raw[i - k : i]][raw[i]] += 1
    bits, raw = 0.0, fold(text)
    for i in range(language.ORDER, len(raw)):
        for k in range(language.ORDER, -1, -1):
            followers = seen.get(raw[i - k : i])
            if not followers:
                continue
            total = sum(followers.values()) + len(followers)
            if raw[i] in followers:
                bits -= math.log2(followers[raw[i]] / total)
                break
            bits -= math.log2(len(followers) / total)
        else:
            bits += 8
    return bits


def test_code_lengths(spark):
    train = {"a": ["the cat sat", "on the mat the", "x"], "b": ["der hund saß", "auf der Matte"], "c": ["zzz"]}
    rows = [(k, l, t) for k, (l, t) in enumerate((l, t) for l, ts in train.items() for t in ts)]
    docs = spark.createDataFrame([*rows, (90, None, "no"), (91, "d", None), (92, "e", "")], "doc_id long, lang string, text string")
    model = language.fit(docs)
    assert model.languages == ["a", "b", "c"]
    texts = ["the hat", "", None, "Die Katze saß", "\x00é漢", "t", "the cat sat" * 20]
    for limit in (1, 1 << 20):
        got = np.concatenate([model.bits(b) for b in blocks(pa.array(texts), limit)])
        want = [[brute_bits(train[l], t or "") for l in "abc"] for t in texts]
        assert np.allclose(got, want)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op3(lambda t: docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (1, None, "en"), (None, "words here", "en"), (2, "123 !!", "de"), (3, "", None), (4, "ein wort " * 50_000, "de"), (5, "mehr worte", "de"), (6, "more words", "en")], "doc_id long, text string, lang string").withColumn("row", F.lit(1)).withColumn("score", F.lit("s"))
    rows = op3(lambda t: docs).collect()
    assert len(rows) == 8
    assert {r.doc_id for r in rows if r.lang_pred == "und" and r.score == 0} >= {1, 2, 3}
    assert op3(lambda t: docs.where("false")).collect() == []
    assert {r.lang_pred for r in op3(lambda t: docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
