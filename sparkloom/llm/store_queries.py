"""Queries over ``embeddings`` and ``pages``: neighbours and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import neighbours, warc
from sparkloom.llm.common import table

SEARCH = neighbours.Search(k=20)


def op9_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, SEARCH)


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back by its URL."""
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""

QUERIES = {"op9_stable_projections": op9_stable_projections, "op10_warc_index": op10_warc_index}
ORACLES = {"op10_warc_index": _OP10_SQL}
