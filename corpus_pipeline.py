"""A training corpus from documents: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run()
writes every stage's result as Parquet and hands the reread table to the next.  The first four return
the columns of docs (any further columns pass through); the last returns token ids and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import bpe, decontaminate, secrets, simhash, toxicity
from gleanery.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; the classifier learns from docs and the labels of sf_dir."""
    return toxicity.clean(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component; documents without id stay."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret span replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text and its length, with n_tokens, ids, and digests of the ids and of the decoded bytes."""
    path, pattern = bpe.vocabulary()
    return bpe.encode(docs, path, pattern, keep=tuple(c for c in docs.columns if c not in ("text", "n_chars")), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secrets", redact_secrets),
    ("byte_bpe", encode_bytes),
]

# Trained scores, connected components and alignments have no SQL; tests/llm/test_pipeline.py holds each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
