"""The thin ``opN_<name>`` queries: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tracewarden.llm import bpe, chat, collocations, decontaminate, language, lexical, licences, pii, quality, secrets, simhash, substring_dedup, toxicity
from tracewarden.llm.oracles import OP6_SQL, OP7_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from tracewarden.llm.registry import query


def _named(spans):
    """``kind:start:end``, comma-joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def _of_kind(kind, spans="spans"):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op1_simhash_near_duplicates")
def op1(read):
    return simhash.near_duplicates(read("documents"))


@query("op7_fm_index_decontamination", OP7_SQL)
def op7(read):
    found = decontaminate.contamination(read("documents"), read("benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op8_ngram_quality_rules")
def op8(read):
    docs = read("documents")
    found = quality.judge(docs, quality.fit(docs, read("labels")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query("op9_streaming_bpe")
def op9(read):
    found = bpe.tokenize(read("documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_token_efficiency_secrets")
def op2(read):
    found = secrets.scan(read("documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[_of_kind(k) for k in ("assign", "access", "hex")],
        F.sha2(_named(base), 256).alias("base_sha256"), _named("spans").alias("spans"),
    )


def _fold(column, divisor):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(divisor)), F.lit(-1))  # no id, no remainder


@query("op4_clause_grammar_toxicity")
def op4(read):
    docs = read("documents")
    held_out = _fold("row.doc_id", 3) == 1
    model = toxicity.fit(docs, read("labels").where(_fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


@query("op3_ppm_language")
def op3(read):
    docs = read("documents")
    model = language.fit(docs.where((_fold("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    held_out = (_fold("row.doc_id", 4) == 2).alias("held_out")
    return language.predict(docs, model).select(F.col("row.doc_id").alias("doc_id"), held_out, "lang_pred", "score")


@query("op10_bilstm_crf_pii")
def op10(read):
    docs = read("documents")
    found = pii.scan(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: ~s["added"])
    return found.select(F.col("row.doc_id").alias("doc_id"), *[_of_kind(k, base) for k in pii.KINDS], F.sha2(_named(base), 256).alias("base_sha256"), _named("spans").alias("spans"))


@query("op5_tfidf_licences")
def op5(read):
    """Documents as files: a source is a tree of directories; in each, documents of the lowest ids are its licence files."""
    ident = F.coalesce("doc_id", F.lit(0))
    number = lambda n: F.floor(ident / n).cast("string")
    name = F.when(ident % 100 < 4, F.concat(F.lit("LICENSE-"), ident.cast("string"))).otherwise(F.concat(ident.cast("string"), F.lit(".txt")))
    folder = F.when(ident % 100 < 2, number(1000)).otherwise(F.concat_ws("/", number(1000), number(100)))
    files = read("documents").select("doc_id", "text", F.concat_ws("/", "source", folder, name).alias("path"))
    found = licences.scan(files, ["doc_id", "path"])
    return found.select("row.doc_id", "row.path", "licence", F.round("similarity", 6).alias("similarity"), "origin")


@query("op6_snapshot_collapse", OP6_SQL)
def op6(read):
    return chat.render(read("conversations"))


@query("op13_accumulator_limited_search", OP13_SQL)
def op13(read):
    return lexical.search(read("documents"), read("benchmark"))


@query("op12_fm_index_substrings", OP12_SQL)
def op12(read):
    found = substring_dedup.dedup(read("documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_son_collocations", OP11_SQL)
def op11(read):
    return collocations.collocations(read("documents"))
