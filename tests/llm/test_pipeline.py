import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import words_of
from tests.llm.test_quality import brute as counts
from tests.llm.test_simhash import brute as groups
from tracewarden.llm import decontaminate, quality, secrets

FOLDER = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    docs = {r.doc_id: r for r in read("documents").collect()}
    # quality: the fixed rules by brute force, the trained verdict by the model itself
    model = quality.fit(read("documents"), read("labels"))
    good = {r.row.doc_id for r in quality.judge(read("documents"), model).where(f"score >= {quality.THRESHOLD}").collect()}
    left = {i: d.text for i, d in docs.items() if not counts(d.text)[-1] and i in good}
    # one of each group
    left = {i: left[i] for i, _, c in groups(list(left.items())) if i == c}
    # contaminated ones go, hit words of others are cut
    windows = {tuple(w[k : k + 13]) for r in read("benchmark").collect() for w in [words_of(r.text)] for k in range(max(1, len(w) - 12) if w else 0)}
    assert all(len(w) == 13 for w in windows)
    clean = {}
    for i, text in left.items():
        w = words_of(text)
        hit = {x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for x in range(k, k + 13)}
        if 20 * len(hit) < len(w) or not hit:
            clean[i] = (text, bool(hit))
    assert set(out) == set(clean)
    words = secrets.vocabulary(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, (text, cut) in clean.items():
        row = out[i]
        if not cut:
            assert row.text == secrets.masked(text, secrets.spans(text, words))
        ids = library.encode(row.text, add_special_tokens=False).ids
        assert row.ids == ids and row.decoded == library.decode(ids, skip_special_tokens=False)
        assert row.n_chars == len(row.text)


def test_schema_and_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.where("false"), FOLDER)
        assert empty.count() == 0
        assert empty.columns[:5] == docs.columns
        if k < len(corpus_pipeline.STAGES) - 1:
            assert empty.dtypes == docs.dtypes


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (None, "a few words " * 30, None, None, 5)], docs.schema)
    both = docs.union(docs).union(odd)
    for _, stage in corpus_pipeline.STAGES:
        both = stage(spark, both, FOLDER).select(*docs.columns)
    assert 0 < both.count() <= 22


def test_stage_order_is_stated():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "secret scan", "bpe encoding and decoding"]
    assert decontaminate.WINDOW == 13
