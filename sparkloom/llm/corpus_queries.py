"""Queries over ``documents``: mixing, personal data, tokens, shards, quality and secrets."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import bpe, mixing, pii, quality, secret_scan, sharding
from sparkloom.llm.common import sha256_hex, table

MIX = mixing.Mix(weights=(3, 1, 2), share=1.5, cap=2.0, block=256, shards=16)
TOKENIZER = "byte_bpe_50k.json"


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), MIX)
    return mixing.taken_words(plan).withColumnRenamed("id", "doc_id")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs))
    return found.select(
        "doc_id",
        *[pii.span_counts(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        sha256_hex(pii.span_list(base_only=True)).alias("base_sha256"),
        pii.span_list().alias("spans"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    shared = bpe.read_vocabulary(spark, public_tokenizers.path(TOKENIZER))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, shared).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest().alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards with about equal bytes."""
    rows = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether it is good enough."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_secret_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))
    return found.select(
        "doc_id",
        *[secret_scan.secret_counts(kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        sha256_hex(secret_scan.secret_list(base_only=True)).alias("base_sha256"),
        secret_scan.secret_list().alias("spans"),
    )


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_personal_data": op2_personal_data,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_kd_shards": op4_kd_shards,
    "op7_quality_votes": op7_quality_votes,
    "op8_secret_tests": op8_secret_tests,
}
ORACLES: dict[str, str] = {}
