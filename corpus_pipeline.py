"""Documents to a filtered, deduplicated, decontaminated, redacted and tokenised corpus.

Each stage works on all that its predecessor kept and gives the columns of ``documents``; the last one adds the token
ids and the text that they decode to.  An empty table passes through; rows without an id are judged like others.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import bpe, decontaminate, quality, secrets, simhash
from tracewarden.session import prepare, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or the trained ones go."""
    return quality.keep(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the few words that others share with test items are cut out."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ``ids`` and ``decoded``."""
    found = bpe.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select(*[found["row"].getField(c).alias(c) for c in docs.columns], "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("bpe encoding and decoding", tokenization),
]

# The trained rules and the encoder are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept; each result is a table in the shared folder."""
    prepare(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
