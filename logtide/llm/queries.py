"""The registered queries of the text operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import (
    alignment,
    bpe,
    license_scan,
    mixing,
    quality,
    quality_rules,
    sharding,
    simhash,
    source_audit,
    spotsigs,
    token_counts,
    token_files,
    topk,
)
from logtide.sources.storage import fresh_folder

#: Tokens a document may have before it is marked as over the limit.
TOKEN_LIMIT = 4096
#: Answers of a vector search, and what components are multiplied by.
TOP_K = 20
VECTOR_SCALE = 64
#: Shards the documents are put into.
SHARDS = 40
#: Seed of the sample and the start of the quality network.
QUALITY_SEED = 7
#: The id that ends a document in the token files.
END_ID = 1
#: Seed of the order in which fractions of sources are sampled.
MIX_SEED = 7


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and sentencepiece tokens of every document."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(_documents(spark, sf_dir), model, TOKEN_LIMIT)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document."""
    return license_scan.scan(_documents(spark, sf_dir))


def op3_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return spotsigs.fingerprint_edits(_documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by weight takes of every document."""
    found = mixing.mix_counts(_documents(spark, sf_dir), MIX_SEED)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), TOP_K, VECTOR_SCALE)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(_documents(spark, sf_dir), SHARDS)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a network fitted on part of the labels."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, quality.train(docs, labels, QUALITY_SEED))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from token files."""
    out = fresh_folder(spark, "token-files")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(_documents(spark, sf_dir), out, vocabulary, END_ID)
    return token_files.read_digests(spark, out)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts of every document, and how far it is from prose of its language."""
    return quality_rules.apply_rules(_documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers share the bytes of every document."""
    path_a, path_b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_documents(_documents(spark, sf_dir), path_a, path_b)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are from each other, and their own words."""
    return source_audit.audit_sources(_documents(spark, sf_dir))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_spot_fingerprints": op3_spot_fingerprints,
    "op4_source_mix": op4_source_mix,
    "op5_simhash": op5_simhash,
    "op6_top_k": op6_top_k,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
    "op11_quality_rules": op11_quality_rules,
    "op12_token_alignment": op12_token_alignment,
    "op13_source_audit": op13_source_audit,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
