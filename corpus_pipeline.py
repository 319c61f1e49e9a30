"""A corpus from raw documents to tokens, in five stages.

Each stage takes the documents that the one before left and returns the columns of ``documents``, the last one
tokens. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import bpe, jaccard, mixing, pii, quality
from sparkloom.llm.common import sha256_hex, table
from sparkloom.session import stage

TOKENIZER = "byte_bpe_50k.json"
NEAR_DUPLICATES = jaccard.Similarity(words=5, percent=80)
MIX = mixing.Mix(weights=(3, 1, 2), share=1.5, cap=2.0, block=256, shards=16)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard.keep_one_per_group(docs, NEAR_DUPLICATES)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return _counted(pii.redact_texts(docs, pii.fit(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row per document and round with the words that the mix takes."""
    return _counted(mixing.mixed_texts(docs, mixing.plan_mix(docs, MIX)))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text they decode to."""
    shared = bpe.read_vocabulary(spark, public_tokenizers.path(TOKENIZER))
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), shared).select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest().alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

# Merging by rank and expectation-maximisation have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
