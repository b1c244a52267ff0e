"""Corpus pipeline: each stage is written as Parquet and read again by the next.

Language identification drops documents without a language, near-duplicate detection
keeps the first document of each group, decontamination drops documents that hold a
benchmark item, the secret scan replaces secrets in texts, and encoding adds token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from upwell.llm import bpe, decontam, langid, minhash, secret_scan
from upwell.llm._common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language, by a model of this input's labelled rows.

    Null texts and those without a letter have none; repeated rows stay or go together.
    """
    model = langid.fit(docs, langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return langid.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group over five-word shingles at 0.8.

    Null and empty texts stay, and so do all rows of a repeated doc_id that is kept.
    """
    return minhash.kept_documents(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found; null and empty texts stay.

    Repeated rows stay or go together.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; documents without any, null texts too, stay as they are.

    Every row is judged alone, so repeated rows stay equal.
    """
    return secret_scan.redacted(spark, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number, and digests of the ids and the decoded text.

    A null text counts as empty; no row is dropped.
    """
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: SQL has no expression for the trained models and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
