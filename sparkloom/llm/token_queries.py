"""Query over ``documents``: token ids, written to binary files and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import token_files
from sparkloom.llm.common import table
from sparkloom.session import stage_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files."""
    folder = stage_path(spark, "token-files")
    shared = token_files.read_tokenizer(spark, public_tokenizers.path(TOKENIZER))
    token_files.store_texts(table(spark, sf_dir, "documents"), shared, END_ID, folder)
    found = token_files.read_token_files(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
