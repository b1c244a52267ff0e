"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from upwell.llm import sql
from upwell.llm._common import Scratch, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


#: 64 shards over a prime number of slots, about a hundred for each.
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(64)], 6449


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.sharding import place

    return place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS, SLOTS)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.toxicity import fit, held_out, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.withColumn("held_out", held_out()), model).drop("text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.token_counts import count_tokens

    scratch = Scratch(spark)  # the cache begins empty, so that each run counts for itself
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER), scratch.path("token_cache"), 512, scratch)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.langid import fit, held_out, identify, load_pieces

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, load_pieces(public_tokenizers.path(PIECES)))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, memo_entries=300_000).drop("text")


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.bpe import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path(TOKENIZER), memo_entries=400_000).drop("text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.secret_scan import report, scan

    return report(scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.pii import scan_pii

    return scan_pii(table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.vector_codes import compress, with_label_error

    scratch = Scratch(spark)
    codes, book = compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256, scratch=scratch)
    rows = with_label_error(scratch.save(codes, "codes"), scratch)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.lexical_search import build_index, search

    scratch = Scratch(spark)
    index = build_index(table(spark, sf_dir, "documents"), scratch)
    return search(index, table(spark, sf_dir, "benchmark"), limit=50, scratch=scratch)


def op13_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from upwell.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), window=1024, keep_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_neardup": op1_embedding_neardup,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_token_counts": op5_token_counts,
        "op6_language_id": op6_language_id,
        "op7_bpe_roundtrip": op7_bpe_roundtrip,
        "op8_secret_scan": op8_secret_scan,
        "op9_pii": op9_pii,
        "op10_minhash_neardup": op10_minhash_neardup,
        "op11_vector_codes": op11_vector_codes,
        "op12_lexical_search": op12_lexical_search,
        "op13_lexical_packing": op13_lexical_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries train a model or run an encoder; tests hold them against plain versions."""
    return {
        "op1_embedding_neardup": sql.embedding_links(0.93),
        "op2_sharding": sql.placement(SHARDS, SLOTS),
        "op10_minhash_neardup": sql.near_duplicates(80),
        "op11_vector_codes": sql.vector_codes(16, 64, 2, 256),
        "op12_lexical_search": sql.lexical_search(50),
    }
