"""Documents without the passages that an earlier document has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import substrings
from sparkloom.llm.common import sha256_hex, table


def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", sha256_hex(cut["kept"]).alias("kept_sha256"))


_OP6_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (g) WHERE m < doc_id),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words),
kept AS (
  SELECT placed.doc_id, string_agg(word, ' ' ORDER BY placed.p) AS t, count(*) AS n
  FROM placed LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p WHERE gone.p IS NULL GROUP BY 1)
SELECT words.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op6_recompression_dedup": op6_recompression_dedup}
ORACLES = {"op6_recompression_dedup": _OP6_SQL}
