"""Queries over ``embeddings``: whitening and centroid clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import centroids, whitening
from sparkloom.llm.common import table

WHITENING = whitening.Whitening(scale=64, shift=1_000_000, components=32)
LLOYD = centroids.Lloyd(dimension=64, clusters=8, rounds=10, scale=1024, seed=3)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the 32 widest components, scaled to variance one."""
    found = whitening.component_rows(whitening.whiten(table(spark, sf_dir, "embeddings"), WHITENING))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after ten rounds."""
    return centroids.cluster_report(centroids.cluster(table(spark, sf_dir, "embeddings"), LLOYD))


def _lloyd_sql(rule: centroids.Lloyd) -> str:
    """The rounds, one after the other, as common table expressions over one row per vector and entry."""

    def nearest(c: str) -> str:
        return f"""SELECT r, k, dist FROM (
            SELECT e.r, c.k, sum((e.x - c.x) * (e.x - c.x)) AS dist FROM e JOIN {c} c USING (d) GROUP BY e.r, c.k)
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, k) = 1"""

    parts = [
        f"""v AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id,
            [CAST(floor({rule.scale:.0f} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x
          FROM embeddings WHERE len(embedding) = {rule.dimension}
            AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"e AS MATERIALIZED (SELECT r, unnest(range({rule.dimension})) AS d, unnest(x) AS x FROM v)",
        f"""firsts AS (
          SELECT r, row_number() OVER (ORDER BY sha256('{rule.seed}:' || vec_id)) - 1 AS k FROM v WHERE vec_id IS NOT NULL
          QUALIFY k < {rule.clusters})""",
        "c0 AS MATERIALIZED (SELECT k, d, x FROM firsts JOIN e USING (r))",
    ]
    for n in range(rule.rounds):
        parts += [
            f"a{n} AS MATERIALIZED ({nearest(f'c{n}')})",
            f"""c{n + 1} AS MATERIALIZED (
              SELECT k, d, coalesce((s - ((s % n) + n) % n) // n, x) AS x
              FROM c{n} LEFT JOIN (SELECT k, d, sum(x) AS s, count(*) AS n FROM a{n} JOIN e USING (r) GROUP BY k, d) USING (k, d))""",
        ]
    last = f"c{rule.rounds}"
    parts += [
        f"a AS MATERIALIZED ({nearest(last)})",
        f"names AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM {last} GROUP BY k)",
    ]
    return f"""WITH {', '.join(parts)}
      SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
        CAST(sum(dist) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
      FROM a JOIN v USING (r) JOIN names USING (k)"""


QUERIES = {"op11_whitening": op11_whitening, "op13_centroids": op13_centroids}
ORACLES = {"op13_centroids": _lloyd_sql(LLOYD)}
