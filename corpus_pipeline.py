"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import bpe, mixing, quality, simhash
from logtide.llm.common import sort_key
from logtide.llm.queries import MIX_SEED, QUALITY_SEED
from logtide.sources.storage import fresh_folder, removed_scratch


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier takes as good; the others go.

    Labels are those of the ``labels`` table, except held-out ones. A null text
    is judged as the empty text, and repeated rows are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels, QUALITY_SEED))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest ``doc_id``.

    Near-duplicates are those of ``op5_simhash``: fingerprints of three-word
    shingles, linked at two or fewer differing bits. Of rows with equal
    ``doc_id`` the one with the smallest checksum stays, and of wholly equal
    rows one. Null keys come last. Texts without words are one group. Documents
    meet the list of those that stay on their key; all rows of a group never
    meet in one task.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(docs.columns)])
    # Null keys last, then the key, then the row's checksum.
    name = F.struct(F.col("doc_id").isNull().alias("_none"), sort_key("doc_id").alias("_key"), row.alias("_row"))
    groups = simhash.near_duplicates(docs.select(name.alias("name"), "text"), key="name")
    kept = groups.where(F.col("name") == F.col("component_id")).select("name.*").distinct()
    named = docs.withColumns({"_none": F.col("doc_id").isNull(), "_key": sort_key("doc_id"), "_row": row})
    keys = ["_key", "_row", "_none"]
    return named.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, three times at most.

    A null source is a source of its own; documents without words count nothing
    and are repeated with their source.
    """
    return mixing.mixed(docs, MIX_SEED)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes they decode to.

    A null text has no ids. A repeated document gives a row each time.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_documents),
]

#: No SQL has the classifier, the fingerprints or the tokenizer; tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next.

    What a stage keeps in scratch space while it works goes when its rows are
    written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = fresh_folder(spark, name.replace(" ", "-"))
        with removed_scratch(spark):
            after = stage(spark, docs, sf_dir)
            after.write.parquet(kept)
        docs = spark.read.schema(after.schema).parquet(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
