import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import toxicity
from tracewarden.llm.queries import op4


def read(spark, sf="sf0.1"):
    return lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")


def test_held_out(spark):
    tables = read(spark)
    rows = op4(tables).join(tables("labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert op4(tables).count() == tables("documents").count()
    hit = [r.predicted for r in rows if r.toxic]
    false = [r.predicted for r in rows if not r.toxic]
    assert np.mean(hit) > 0.88 and np.mean(false) < 0.01


@pytest.mark.parametrize(("symbols", "kind"), [
    ("", "none"), ("WWW", "none"), ("WIW", "plain"), ("YWI", "aimed"), ("IWWY", "aimed"), ("NWI", "negated"), ("NWWWWI", "plain"),
    ("RWI", "reported"), ("IR", "plain"), ("YT", "threat"), ("NT", "negated"), ("NIWWWI", "plain"), ("RNI", "negated"), ("Y", "none"),
])
def test_grammar(symbols, kind):
    assert toxicity.kind_of(symbols) == kind


def test_clauses():
    from tracewarden.llm.byte_text import blocks

    model = toxicity.Model({"réê".encode(): 2.0, b"idiot": 3.0, b"kill": 5.0})
    texts = ["You IDIOTS. not an idiot; he said idiot\nRÉÊX, x", "", None, "xidiot idio", "I will kill you", "a idiot" + " b" * 50_000 + " idiot"]
    import pyarrow as pa

    for limit in (1, 1 << 20):
        got = [(b.lo + r, k, w) for b in blocks(pa.array(texts), limit) for r, k, w in model.clauses(b)[1]]
        assert sorted(got) == [(0, "aimed", 3.0), (0, "negated", 3.0), (0, "plain", 2.0), (0, "reported", 3.0), (4, "threat", 5.0), (5, "plain", 6.0)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x " * 200_000), (3, "rotten fool")], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 1), (1, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        rows = op4({"documents": docs, "labels": labels}.get).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert op4({"documents": docs.where("false"), "labels": none}.get).collect() == []
