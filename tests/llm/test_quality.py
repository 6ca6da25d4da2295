import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import quality
from tracewarden.llm.byte_text import NOT_SPACE, blocks
from tracewarden.llm.queries import op8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    at = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {w for ks in at.values() if len(ks) > 1 for k in ks for w in range(k, k + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_whole_tables_and_held_out(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    rows = {r.doc_id: r for r in op8(read).collect()}
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        assert tuple(rows[i][c] for c in COUNTS) == brute(text)
    # labels of even ids train, odd ones test
    labels = read("labels")
    model = quality.fit(read("documents"), labels.where("doc_id % 2 = 0"))
    judged = {r.id: r.kept for r in quality.judge(read("documents"), model).select(F.col("row.doc_id").alias("id"), "kept").collect()}
    truth = [(r.quality, judged[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect() if brute(docs[r.doc_id])[0] >= 20]
    good, bad = [k for q, k in truth if q], [k for q, k in truth if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_edges(spark):
    texts = [None, "", " \n\t\n", "a", "a b c d e f g h " * 3, "é# 漢字 | <x>\n" * 30, "x y\n x y\nx y\n\n\n", "w " * 200_000, "a b\x0bc\x1cd\x85e", "a b c d e f g h", "a b c d e f g h", "p q r s t u v w\nx", " lead\ntrail "]
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("score", F.lit("s")).withColumn("kept", F.lit(None).cast("int"))
    labels = spark.createDataFrame([(4, 0), (5, 1), (5, 1), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.row.text: r for r in quality.judge(docs, model).collect()}
    for t in texts:
        assert tuple(got[t][c] for c in COUNTS) == brute(t), t
    assert quality.keep(docs, labels).columns == docs.columns


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "word other " * 5 + " ".join(map(str, range(40))))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep(docs, labels).count() == 1
    assert quality.keep(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("limit", [1, 30, 10_000])
def test_blocks_do_not_matter(limit):
    import pyarrow as pa

    texts = ["", "a b c d", None, "one two three four five six seven eight " * 2, "zz", "é é"]
    model = quality.Model(np.random.default_rng(0).normal(size=3 << quality.BITS).astype(np.float32), 0.1, 1.0, 0.0)
    z = np.concatenate([model.margins(b, b.runs(NOT_SPACE)) for b in blocks(pa.array(texts), limit)])
    alone = [float(model.margins(b, b.runs(NOT_SPACE))[0]) for t in texts for b in blocks(pa.array([t], pa.string()))]
    assert np.allclose(z, alone)
