"""Queries over mask values, weights and position vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions import schedules
from sparkloom.operators import selection, vectors as vec
from sparkloom.plans import views as v
from sparkloom.plans.registry import query

r6 = lambda c: F.round(c, 6)
DIM = 64


@query(
    "threshold_for_share",
    f"""WITH RECURSIVE {v.MASK_VALUES_SQL}, bisect(i, l, r) AS (
      SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
      UNION ALL
      SELECT i + 1, CASE WHEN over THEN l ELSE m END, CASE WHEN over THEN m ELSE r END
      FROM (SELECT i, l, r, (l + r) / 2 AS m, (SELECT count(*) FROM mask_values WHERE value <= (l + r) / 2)
              > (SELECT count(*) FROM mask_values) * CAST(0.7 AS DOUBLE) AS over FROM bisect WHERE r - l > 1e-8))
    SELECT round((l + r) / 2, 9) AS threshold FROM bisect WHERE r - l <= 1e-8""",
)
def threshold_for_share(spark: SparkSession, sf: str) -> DataFrame:
    return selection.threshold_for_share(v.mask_values(spark, sf), 0.7).select(F.round("threshold", 9).alias("threshold"))


@query(
    "round_top_share",
    f"""WITH {v.MASK_VALUES_SQL} SELECT layer, head, CASE WHEN row_number() OVER (ORDER BY value DESC, md5('42:' || layer || ':' || head), layer, head)
      <= floor((SELECT count(*) FROM mask_values) * (1.0 - CAST(0.7 AS DOUBLE))) THEN 10.0 ELSE -10.0 END AS rounded FROM mask_values""",
    casts="rounded DOUBLE",
)
def round_top_share(spark: SparkSession, sf: str) -> DataFrame:
    return selection.round_top_share(v.mask_values(spark, sf), ["layer", "head"], 0.7).drop("value")


@query(
    "any_gate",
    f"""WITH {v.MASK_VALUES_SQL} SELECT layer, bool_or(value > 0.95) AS full_path, count(*) AS members FROM mask_values GROUP BY layer""",
)
def any_gate(spark: SparkSession, sf: str) -> DataFrame:
    return selection.any_gate(v.mask_values(spark, sf).withColumn("keep", F.col("value") > 0.95), "layer")


@query(
    "route_entropy",
    f"""WITH {v.MASK_VALUES_SQL} SELECT head % 97 AS sample, round(avg(-value * ln(value + 1e-8)), 6) AS entropy,
      round(avg(-value * ln(value + 1e-8) - (1 - value) * ln(1 - value + 1e-8)), 6) AS binary_entropy FROM mask_values GROUP BY 1""",
)
def route_entropy(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("value")
    return v.mask_values(spark, sf).groupBy(F.pmod("head", F.lit(97)).alias("sample")).agg(
        r6(F.avg(schedules.route_entropy(p))).alias("entropy"),
        r6(F.avg(schedules.route_entropy(p, binary=True))).alias("binary_entropy"),
    )


@query(
    "scale_softmax",
    f"""WITH {v.WEIGHTS_SQL}, e AS (SELECT group_id, item, exp((weight - max(weight) OVER (PARTITION BY group_id)) / 8.0) AS e FROM weights)
    SELECT group_id, item, round(e / sum(e) OVER (PARTITION BY group_id), 6) AS share FROM e""",
)
def scale_softmax(spark: SparkSession, sf: str) -> DataFrame:
    shares = selection.scale_softmax(v.weights(spark, sf), "group_id", "weight", 8.0)
    return shares.select("group_id", "item", r6("share").alias("share"))


@query(
    "weighted_pick",
    f"""WITH {v.WEIGHTS_SQL}, s AS (SELECT group_id, item, exp((weight - max(weight) OVER (PARTITION BY group_id)) / 8.0)
      / greatest(-ln(u), 1e-10) AS score, count(*) OVER (PARTITION BY group_id) AS items FROM weights)
    SELECT group_id, item, items FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, item) AS r FROM s) WHERE r = 1""",
)
def weighted_pick(spark: SparkSession, sf: str) -> DataFrame:
    return selection.weighted_pick(v.weights(spark, sf), "group_id", "item", "weight", "u", 8.0)


@query(
    "vocab_lookup",
    """SELECT event_id, round(coalesce(list_sum(CAST(e.embedding AS DOUBLE[])), 0), 6) AS total,
      round(coalesce(CAST(e.embedding[1] AS DOUBLE), 0), 6) AS head, e.vec_id IS NOT NULL AS known
    FROM (SELECT event_id, event_id % 4000 AS id FROM events) v LEFT JOIN embeddings e ON e.vec_id = v.id""",
)
def vocab_lookup(spark: SparkSession, sf: str) -> DataFrame:
    table = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")
    )
    ids = v.table(spark, sf, "events").select("event_id", F.pmod("event_id", F.lit(4000)).alias("token"))
    found = vec.vocab_lookup(ids, table, "token", DIM)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    known = F.exists("vec", lambda x: x != 0.0)
    return found.select("event_id", r6(total).alias("total"), r6(F.get("vec", F.lit(0))).alias("head"), known.alias("known"))


@query(
    "last_token",
    f"""WITH {v.POSITION_VECTORS_SQL} SELECT seq_id, max(pos) AS pos, round(arg_max(vec[1], pos), 6) AS head FROM position_vectors GROUP BY 1""",
)
def last_token(spark: SparkSession, sf: str) -> DataFrame:
    last = selection.last_token(v.position_vectors(spark, sf), "seq_id", columns=["vec"])
    return last.select("seq_id", "pos", r6(F.get("vec", F.lit(0))).alias("head"))


@query(
    "gated_blend",
    f"""WITH {v.POSITION_VECTORS_SQL}, z AS (SELECT a.seq_id, a.pos, a.vec AS va, b.vec AS vb, (a.pos % 5) / 4.0 AS g
      FROM position_vectors a JOIN position_vectors b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1)
    SELECT seq_id, pos, round(g * va[1] + (1 - g) * vb[1], 6) AS first_dim,
      round(list_sum(list_transform(va, lambda x, i: g * x + (1 - g) * vb[i])), 6) AS total FROM z""",
)
def gated_blend(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.position_vectors(spark, sf)
    after = rows.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("vec").alias("b"))
    gate = F.pmod("pos", F.lit(5)) / 4.0
    blend = rows.join(after, ["seq_id", "pos"]).select("seq_id", "pos", schedules.gated_blend(gate, F.col("vec"), F.col("b")).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return blend.select("seq_id", "pos", r6(F.get("z", F.lit(0))).alias("first_dim"), r6(total).alias("total"))


def _ranges(rows: DataFrame) -> DataFrame:
    """Three quarters of each sequence as user turn, the rest as answer."""
    sizes = rows.groupBy("seq_id").agg((F.max("pos") + 1).alias("n"))
    user = F.floor(F.col("n") * 0.75).cast("int")
    zero = F.lit(0)
    return sizes.select(
        "seq_id", F.array(zero, zero, zero, user - 1, zero, user - 1, user, F.col("n") - 1).alias("range_ids")
    )


POOL_SQL = f"""{v.POSITION_VECTORS_SQL}, sizes AS (SELECT seq_id, max(pos) + 1 AS n FROM position_vectors GROUP BY 1),
  spans AS (SELECT seq_id, 'ctx_q' AS segment, 0 AS s, CAST(floor(n * 0.75) AS INTEGER) - 1 AS e FROM sizes
    UNION ALL SELECT seq_id, 'a', CAST(floor(n * 0.75) AS INTEGER), n - 1 FROM sizes
    UNION ALL SELECT seq_id, 'first_token', 0, 0 FROM sizes),
  hits AS (SELECT sp.seq_id, sp.segment, p.vec,
      (CASE WHEN p.pos < sp.s + 20 THEN 1 ELSE 0 END) + (CASE WHEN p.pos > sp.e - 20 THEN 1 ELSE 0 END) AS w
    FROM spans sp JOIN position_vectors p ON p.seq_id = sp.seq_id AND p.pos BETWEEN sp.s AND sp.e),
  dims AS (SELECT seq_id, segment, w, unnest(vec) AS x, unnest(range(1, {DIM + 1})) AS d FROM hits)"""


@query(
    "segment_pool",
    f"""WITH {POOL_SQL} SELECT seq_id, segment, d AS dim, round(sum(w * x) / sum(w), 6) AS value FROM dims GROUP BY ALL HAVING sum(w) > 0""",
)
def segment_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.position_vectors(spark, sf)
    out = vec.segment_pool(rows, _ranges(rows), ["ctx_q", "a", "first_token"], 20, DIM)
    return out.select("seq_id", "segment", F.posexplode("pooled").alias("at", "x")).select(
        "seq_id", "segment", (F.col("at") + 1).alias("dim"), r6("x").alias("value")
    )


@query(
    "mean_pool",
    f"""WITH {v.POSITION_VECTORS_SQL}, dims AS (SELECT seq_id, unnest(vec) AS x, unnest(range(1, {DIM + 1})) AS d FROM position_vectors)
    SELECT seq_id, d AS dim, round(avg(x), 6) AS value FROM dims GROUP BY ALL""",
)
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vec.mean_pool(v.position_vectors(spark, sf), DIM)
    return pooled.select("seq_id", F.posexplode("pooled").alias("at", "x")).select(
        "seq_id", (F.col("at") + 1).alias("dim"), r6("x").alias("value")
    )


def sample_router(softmax: bool = True) -> vec.Router:
    """Weights made by a rule; a caller would pass trained ones."""

    def layer(rows: int, cols: int, salt: int):
        grid = np.arange(rows * cols, dtype=np.float64).reshape(rows, cols)
        return np.sin(grid * 0.37 + salt) / np.sqrt(rows), np.cos(np.arange(cols) + salt) * 0.01

    features = (layer(DIM, 8 * DIM, 1), layer(8 * DIM, 2 * DIM, 2))
    head = (layer(2 * DIM, 4 * DIM, 3), layer(4 * DIM, DIM, 4), layer(DIM, 2 if softmax else 1, 5))
    return vec.Router(features, head, softmax)


def _layer_sql(x: str, rows: int, cols: int, salt: int, silu: bool) -> str:
    out = f"""list_transform(range({cols}), lambda c: list_dot_product({x}, list_transform(range({rows}),
      lambda r: sin((r * {cols} + c) * CAST(0.37 AS DOUBLE) + {salt}) / sqrt({rows}))) + cos(c + {salt}) * CAST(0.01 AS DOUBLE))"""
    return f"list_transform({out}, lambda y: y / (1 + exp(-y)))" if silu else out


ROUTE_SQL = f"""{POOL_SQL},
  means AS (SELECT seq_id, d, sum(w * x) / sum(w) AS x FROM dims WHERE segment = 'ctx_q' GROUP BY ALL),
  pooled AS (SELECT seq_id, list(x ORDER BY d) AS x FROM means GROUP BY seq_id),
  f1 AS MATERIALIZED (SELECT seq_id, {_layer_sql('x', DIM, 8 * DIM, 1, True)} AS x FROM pooled),
  f2 AS MATERIALIZED (SELECT seq_id, {_layer_sql('x', 8 * DIM, 2 * DIM, 2, False)} AS x FROM f1),
  h1 AS MATERIALIZED (SELECT seq_id, {_layer_sql('x', 2 * DIM, 4 * DIM, 3, True)} AS x FROM f2),
  h2 AS MATERIALIZED (SELECT seq_id, {_layer_sql('x', 4 * DIM, DIM, 4, True)} AS x FROM h1),
  logits AS MATERIALIZED (SELECT seq_id, {_layer_sql('x', DIM, 2, 5, False)} AS x FROM h2)"""


@query(
    "route_decision",
    f"""WITH {ROUTE_SQL} SELECT seq_id, round(1 / (1 + exp((x[1] - x[2]) / 1.25)), 6) AS share, x[2] > x[1] AS full_path FROM logits""",
)
def route_decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.position_vectors(spark, sf)
    pooled = vec.segment_pool(rows, _ranges(rows), ["ctx_q"], 20, DIM)
    routed = vec.route_decision(pooled, sample_router(), tau=1.25)
    return routed.select("seq_id", r6("share").alias("share"), "full_path")


_U_SQL = "(CAST('0x' || substr(md5('42:' || seq_id || ':{i}'), 1, 7) AS INTEGER) + 0.5) / 268435456.0"


@query(
    "gumbel_route",
    f"""WITH {ROUTE_SQL}, noisy AS (SELECT seq_id,
        x[1] - ln(-ln({_U_SQL.format(i=0)} + 1e-8) + 1e-8) AS a, x[2] - ln(-ln({_U_SQL.format(i=1)} + 1e-8) + 1e-8) AS b FROM logits),
      shares AS (SELECT seq_id, 1 / (1 + exp((a - b) / 1.25)) AS share, b > a AS full_path FROM noisy)
    SELECT seq_id, round(share, 6) AS share, full_path, round(-share * ln(share + 1e-8), 6) AS entropy FROM shares""",
)
def gumbel_route(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.position_vectors(spark, sf)
    pooled = vec.segment_pool(rows, _ranges(rows), ["ctx_q"], 20, DIM)

    def uniform(i: int):
        mark = F.md5(F.concat_ws(":", F.lit("42"), "seq_id", F.lit(str(i))))
        return (F.conv(F.substring(mark, 1, 7), 16, 10).cast("int") + 0.5) / float(1 << 28)

    routed = vec.route_decision(pooled, sample_router(), tau=1.25, noise=[vec.gumbel(uniform(0)), vec.gumbel(uniform(1))])
    entropy = schedules.route_entropy(F.col("share"))
    return routed.select("seq_id", r6("share").alias("share"), "full_path", r6(entropy).alias("entropy"))


BLOCK, STRIDE = 16, 4
BLOCKS_SQL = f"{v.POSITION_VECTORS_SQL}, blocks AS (SELECT DISTINCT seq_id, pos // {BLOCK} AS qb FROM position_vectors)"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return v.position_vectors(spark, sf).select("seq_id", F.floor(F.col("pos") / BLOCK).cast("int").alias("qb")).distinct()


@query(
    "causal_pairs",
    f"""WITH {BLOCKS_SQL} SELECT q.seq_id, q.qb, count(*) AS keys, sum(k.qb) AS key_sum FROM blocks q
    JOIN blocks k ON k.seq_id = q.seq_id AND k.qb <= q.qb GROUP BY ALL""",
    casts="key_sum BIGINT",
)
def causal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return vec.ranged_pairs(_blocks(spark, sf).withColumn("ranges", vec.causal_ranges(F.col("qb"))))


@query(
    "local_window_pairs",
    f"""WITH {v.POSITION_VECTORS_SQL} SELECT q.seq_id, q.pos, count(*) AS keys, sum(k.pos) AS key_sum, round(avg(k.vec[1]), 6) AS local_mean
    FROM position_vectors q JOIN position_vectors k ON k.seq_id = q.seq_id AND k.pos <= q.pos AND k.pos > q.pos - 10 GROUP BY ALL""",
    casts="key_sum BIGINT",
)
def local_window_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.position_vectors(spark, sf)
    pairs = vec.ranged_pairs(rows.select("seq_id", "pos", vec.local_ranges(F.col("pos"), 10).alias("ranges")))
    return pairs.join(vec.local_mean(rows, 10), ["seq_id", "pos"]).withColumn("local_mean", r6("local_mean"))


SINK, LOCAL = vec.blocks_of(8, 8), vec.blocks_of(20, 8)  # in blocks of 8 positions


@query(
    "sink_local_pairs",
    f"""WITH {v.POSITION_VECTORS_SQL}, b AS (SELECT DISTINCT seq_id, pos // 8 AS qb FROM position_vectors)
    SELECT q.seq_id, q.qb, count(*) AS keys, sum(k.qb) AS key_sum FROM b q JOIN b k ON k.seq_id = q.seq_id AND k.qb <= q.qb
      AND (k.qb < {SINK} OR k.qb > q.qb - {LOCAL}) GROUP BY ALL""",
    casts="key_sum BIGINT",
)
def sink_local_pairs(spark: SparkSession, sf: str) -> DataFrame:
    blocks = v.position_vectors(spark, sf).select("seq_id", F.floor(F.col("pos") / 8).cast("int").alias("qb")).distinct()
    return vec.ranged_pairs(blocks.withColumn("ranges", vec.sink_local_ranges(F.col("qb"), SINK, LOCAL)))


@query(
    "triangle_pairs",
    f"""WITH {v.POSITION_VECTORS_SQL}, sized AS (SELECT seq_id, max(pos) + 1 AS n FROM position_vectors GROUP BY 1)
    SELECT q.seq_id, q.pos, count(*) AS keys, sum(k.pos) AS key_sum FROM position_vectors q JOIN sized s ON s.seq_id = q.seq_id
    JOIN position_vectors k ON k.seq_id = q.seq_id AND k.pos <= q.pos
      AND (s.n - q.pos <= 12 OR k.pos // 8 < {SINK} OR k.pos // 8 > q.pos // 8 - {LOCAL}) GROUP BY ALL""",
    casts="key_sum BIGINT",
)
def triangle_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.position_vectors(spark, sf).select("seq_id", "pos")
    sizes = rows.groupBy("seq_id").agg((F.max("pos") + 1).alias("n"))
    ranges = vec.triangle_ranges(F.col("pos"), F.col("n"), SINK, LOCAL, 8, 12)
    return vec.ranged_pairs(rows.join(sizes, "seq_id").select("seq_id", "pos", ranges.alias("ranges")))


MASS_SQL = f"""{v.POSITION_VECTORS_SQL},
  q AS (SELECT seq_id, pos // {STRIDE} AS g, flatten(list(vec ORDER BY pos DESC)) AS x FROM position_vectors GROUP BY ALL),
  k AS (SELECT seq_id, pos // {STRIDE} AS g, flatten(list(vec ORDER BY pos)) AS x FROM position_vectors GROUP BY ALL),
  s AS (SELECT q.seq_id, q.g AS qg, k.g AS kg, list_dot_product(q.x, k.x) / sqrt({DIM}) / {STRIDE} AS x
        FROM q JOIN k ON k.seq_id = q.seq_id AND k.g <= q.g),
  e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY seq_id, qg)) AS e FROM s),
  p AS (SELECT *, e / sum(e) OVER (PARTITION BY seq_id, qg) AS p FROM e),
  mass AS (SELECT seq_id, qg // {BLOCK // STRIDE} AS qb, kg // {BLOCK // STRIDE} AS kb, sum(p) AS score FROM p GROUP BY ALL)"""


@query("block_mass", f"WITH {MASS_SQL} SELECT seq_id, qb, kb, round(score, 6) AS score FROM mass")
def block_mass(spark: SparkSession, sf: str) -> DataFrame:
    return vec.block_mass(v.position_vectors(spark, sf), DIM, BLOCK, STRIDE).withColumn("score", r6("score"))


@query(
    "top_p_blocks",
    f"""WITH {MASS_SQL}, f AS (SELECT *, kb = 0 OR kb = qb AS forced, sum(score) OVER (PARTITION BY seq_id, qb) AS total FROM mass),
    o AS (SELECT *, coalesce(sum(score) OVER (PARTITION BY seq_id, qb ORDER BY CASE WHEN forced THEN 0 ELSE 1 END, score DESC, kb
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT seq_id, qb, kb, forced OR round(before, 9) < round(total * CAST(0.7 AS DOUBLE), 9) AS keep FROM o""",
)
def top_p_blocks(spark: SparkSession, sf: str) -> DataFrame:
    mass = vec.block_mass(v.position_vectors(spark, sf), DIM, BLOCK, STRIDE)
    return selection.top_p_blocks(mass, 0.7).drop("score")
