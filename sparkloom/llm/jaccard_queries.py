"""Near-duplicate documents under a Jaccard join of four-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import jaccard
from sparkloom.llm.common import table

RULE = jaccard.Similarity(words=4, percent=85)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), RULE)
    return found.select("doc_id", "n_shingles", "component_id")


_OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words),
sizes AS MATERIALIZED (
  SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT a, a FROM ways UNION SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT sizes.doc_id, n AS n_shingles, coalesce(m, sizes.doc_id) AS component_id
FROM sizes LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY 1) q ON q.doc_id = sizes.doc_id
"""

QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {"op5_jaccard_join": _OP5_SQL}
