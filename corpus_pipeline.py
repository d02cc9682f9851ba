"""The corpus pipeline: documents without toxic ones, near copies and secrets, mixed to weights, as tokens.

STAGES lists name and function of each stage in order; run applies them to
documents.  A stage's rows are written as Parquet and read again by the next.
Nulls may stand in any column and further columns may have any name: all stages
but the last return the columns they got.  Null and empty texts are copies of each
other, so one of them stays; it is taken once and has no tokens.  Of repeated rows
one stays.  Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, mixing, neardup, secrets, toxicity
from lodestar.llm.queries import VOCABULARY
from lodestar.llm.shared import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return neardup.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars counts the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their ids, number and digests. No tokens for null and empty texts; a row for each row."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("tokens", encode_tokens)]

#: SQL cannot express the stages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
