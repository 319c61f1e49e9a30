"""Position vectors: lookups, pooling, routing, block pairs and block mass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkloom.operators.lookups import lookup_join

# Places in the range array where a segment starts and ends.
SEGMENTS = {"first_token": (0, 1), "ctx": (2, 3), "q": (4, 5), "a": (6, 7), "ctx_q": (2, 5)}


def vocab_lookup(ids: DataFrame, table: DataFrame, key: str, dim: int) -> DataFrame:
    """Vector of each id; ids outside the table give zeros. ``table``: id, vec."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    found = lookup_join(ids, table.select(F.col("id").alias(key), "vec"), key)
    return found.withColumn("vec", F.coalesce("vec", zeros))


_WEIGHT, _TOTAL = "_weight", "_total"


def _batch_sums(keys: list[str], vec: str, dim: int):
    """Batches of (keys, vector, weight) to one weighted sum per key of the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            groups = rows.groupby(keys, dropna=False, sort=False)
            codes, first = groups.ngroup().to_numpy(), groups.head(1)[keys]
            weight = rows[_WEIGHT].to_numpy(float)
            weights = np.bincount(codes, weight)
            sums = np.zeros((len(weights), dim))
            # one slice of rows per key, added by the vector
            order = np.argsort(codes, kind="stable")
            edges = np.append(0, np.cumsum(np.bincount(codes)))
            values = rows[vec].to_numpy()
            for code in range(len(weights)):
                own = order[edges[code] : edges[code + 1]]
                sums[code] = weight[own] @ np.stack([np.asarray(values[k], float) for k in own])
            yield first.assign(**{_TOTAL: list(sums), _WEIGHT: weights})

    return run


def _added(keys: list[str]):
    """The partial sums of one key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[keys].head(1).assign(**{_TOTAL: [np.sum(np.stack(rows[_TOTAL].to_numpy()), axis=0)], _WEIGHT: rows[_WEIGHT].sum()})

    return run


def mean_vectors(rows: DataFrame, keys: list[str], vec: str, dim: int, weight: Column | None = None) -> DataFrame:
    """(keys, pooled): the weighted mean vector of each key; zeros where the weights are none.

    A batch of rows is added up before the shuffle, vector by vector, so what is shuffled is one vector per key and batch,
    whatever the number of rows or dimensions. A null entry of a vector makes the mean's entry NaN.
    """
    weighed = rows.select(*keys, vec, (F.lit(1.0) if weight is None else weight).cast("double").alias(_WEIGHT))
    kinds = [weighed.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField(_TOTAL, T.ArrayType(T.DoubleType())), T.StructField(_WEIGHT, T.DoubleType())])
    partial = weighed.mapInPandas(_batch_sums(keys, vec, dim), schema)
    sums = partial.groupBy(*keys).applyInPandas(_added(keys), schema)
    mean = F.transform(_TOTAL, lambda x: F.coalesce(F.try_divide(x, F.col(_WEIGHT)), F.lit(0.0)))
    return sums.select(*keys, mean.alias("pooled"))


def segment_pool(
    vectors: DataFrame, ranges: DataFrame, segments: list[str], pool: int, dim: int, head: str | None = None
) -> DataFrame:
    """Mean of the first and the last ``pool`` positions of each segment of each sequence.

    A position in both ends counts twice; an empty segment gives zeros. Both ends
    stay inside the segment. ``ranges``: seq_id, range_ids. One pass for all segments; a position goes on only
    with the segments whose ends it lies in. With ``head`` each head is pooled by itself.
    """
    unknown = [s for s in segments if s not in SEGMENTS]
    if unknown:
        raise ValueError(f"unknown segments: {', '.join(unknown)}")
    spans = F.array(
        *[
            F.struct(
                F.lit(s).alias("segment"),
                F.get("range_ids", F.lit(SEGMENTS[s][0])).alias("start"),
                F.get("range_ids", F.lit(SEGMENTS[s][1])).alias("end"),
            )
            for s in segments
        ]
    )
    pos = F.col("pos")

    def times(span: Column) -> Column:
        inside = pos.between(span["start"], span["end"])
        first, last = inside & (pos < span["start"] + pool), inside & (pos > span["end"] - pool)
        return first.cast("int") + last.cast("int")

    keys = ["seq_id"] + ([head] if head else [])
    met = vectors.join(ranges.select("seq_id", spans.alias("_spans")), "seq_id")
    used = F.filter(F.transform("_spans", lambda x: F.struct(x["segment"].alias("segment"), times(x).alias("_times"))), lambda x: x["_times"] > 0)
    taken = met.select(*keys, "vec", F.inline(used))
    found = mean_vectors(taken, [*keys, "segment"], "vec", dim, F.col("_times"))
    every = vectors.select(*keys).distinct().join(ranges.select("seq_id"), "seq_id")
    wanted = every.select("*", F.explode(F.array(*[F.lit(s) for s in segments])).alias("segment"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return wanted.join(found, [*keys, "segment"], "left").withColumn("pooled", F.coalesce("pooled", zeros))


def mean_pool(vectors: DataFrame, dim: int) -> DataFrame:
    """Mean over all positions."""
    return mean_vectors(vectors, ["seq_id"], "vec", dim)


def mean_heads(pooled: DataFrame, dim: int, head: str = "head") -> DataFrame:
    """Mean of the pooled vectors of all heads: the input of a router that decides for all of them."""
    keys = [c for c in pooled.columns if c not in (head, "pooled")]
    return mean_vectors(pooled, keys, "pooled", dim)


def for_heads(routed: DataFrame, heads: int, head: str = "head") -> DataFrame:
    """A decision for every head."""
    return routed.select("*", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias(head))


def learned_tau(log_temperature: float | Column) -> Column:
    """A trained temperature, held between 0.3 and 1."""
    t = log_temperature if isinstance(log_temperature, Column) else F.lit(float(log_temperature))
    return F.least(F.greatest(F.exp(t), F.lit(0.3)), F.lit(1.0))


def ends_pool(vectors: DataFrame, pool: int, dim: int) -> DataFrame:
    """Mean of the first and the last ``pool`` positions of the whole sequence."""
    zero = F.lit(0)
    whole = vectors.groupBy("seq_id").agg(F.max("pos").alias("_last"))
    ranges = whole.select("seq_id", F.array(zero, zero, zero, F.col("_last")).alias("range_ids"))
    return segment_pool(vectors, ranges, ["ctx"], pool, dim).drop("segment")


@dataclass(frozen=True)
class Router:
    """Weights of the scoring network: two feature layers, three head layers, as (matrix, bias)."""

    features: tuple
    head: tuple
    softmax: bool = True

    def logits(self, x: np.ndarray) -> np.ndarray:
        for layers in (self.features, self.head):
            for i, (w, b) in enumerate(layers):
                x = x @ w + b
                if i < len(layers) - 1:
                    x = x / (1.0 + np.exp(-x))  # SiLU
        return x


def gumbel(u: Column, eps: float = 1e-8) -> Column:
    return -F.log(-F.log(u + eps) + eps)


def route_decision(
    pooled: DataFrame, router: Router, tau: float | Column = 1.0, noise: list[Column] | None = None
) -> DataFrame:
    """Share and hard choice of the full path for each pooled vector.

    The network runs on Arrow batches with weights shipped once per worker; the
    temperature, noise, softmax and choice stay in SQL.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if len(vectors) == 0:
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(router.logits(np.stack(vectors.to_numpy()))))

    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    scored = pooled.withColumn("logits", score("pooled"))
    outputs = 2 if router.softmax else 1
    shift = noise or [F.lit(0.0)] * outputs
    part = [(F.get("logits", F.lit(i)) + shift[i]) / t for i in range(outputs)]
    if router.softmax:
        share = 1 / (1 + F.exp(part[0] - part[1]))
        hard = part[1] > part[0]  # a draw goes to the first class, as argmax does
    else:
        share = 1 / (1 + F.exp(-part[0]))
        hard = share > 0.5
    return scored.select(*[c for c in pooled.columns if c != "pooled"], "logits", share.alias("share"), hard.alias("full_path"))


def _range(start: Column, end: Column) -> Column:
    return F.struct(F.greatest(start, F.lit(0)).cast("int").alias("from"), end.cast("int").alias("to"))


def causal_ranges(q: Column) -> Column:
    """Keys 0..q of a query. Pairs are kept as ranges; nothing quadratic is stored."""
    return F.array(_range(F.lit(0), q))


def local_ranges(q: Column, window: int) -> Column:
    """The last ``window`` keys up to the query."""
    return F.array(_range(q - (window - 1), q))


def sink_local_ranges(q: Column, sink: int, local: int) -> Column:
    """The first ``sink`` keys and the last ``local`` up to the query, without overlap."""
    near = q - (local - 1)
    return F.when(near <= sink, causal_ranges(q)).otherwise(
        F.array(_range(F.lit(0), F.least(F.lit(sink - 1), q)), _range(near, q))
    )


def block_ranges_to_positions(ranges: Column, pos: Column, block: int) -> Column:
    """Ranges over key blocks as ranges over key positions, up to the query position."""
    return F.transform(
        ranges, lambda r: _range(r["from"] * block, F.least((r["to"] + 1) * block - 1, pos))
    )


def triangle_ranges(pos: Column, length: Column, sink: int, local: int, block: int, last: int) -> Column:
    """Sink and local blocks, but every earlier key for the last ``last`` positions."""
    near = sink_local_ranges(F.floor(pos / block).cast("int"), sink, local)
    return F.when(length - pos <= last, causal_ranges(pos)).otherwise(block_ranges_to_positions(near, pos, block))


def toggle_ranges(
    toggle: str, pos: Column, length: Column, sink: int = 0, local: int = 0, window: int = 0, last: int = 0, block: int = 128
) -> Column:
    """Key positions a query position may use, by the name of the rule."""
    if toggle == "none":
        return causal_ranges(pos)
    if toggle == "local":
        return local_ranges(pos, window)
    if toggle == "streaming":
        return triangle_ranges(pos, length, sink, local, block, 0)
    if toggle == "triangle":
        return triangle_ranges(pos, length, sink, local, block, last)
    raise ValueError(f"unknown toggle: {toggle}")


def blocks_of(size: int, block: int = 128) -> int:
    """Blocks that cover ``size`` positions."""
    return -(-size // block)


def ranged_pairs(df: DataFrame, ranges: str = "ranges") -> DataFrame:
    """Size and bounds of each query's key set."""
    count = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, r: a + r["to"] - r["from"] + 1)
    total = F.aggregate(
        ranges, F.lit(0).cast("bigint"),
        lambda a, r: a + ((r["from"] + r["to"]).cast("bigint") * (r["to"] - r["from"] + 1) / 2).cast("bigint"),
    )
    return df.withColumns({"keys": count, "key_sum": total}).drop(ranges)


def local_mean(vectors: DataFrame, window: int, element: int = 0) -> DataFrame:
    """Mean of one element over the last ``window`` positions; needs no pairs at all."""
    near = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(-(window - 1), Window.currentRow)
    return vectors.select("seq_id", "pos", F.avg(F.get("vec", F.lit(element))).over(near).alias("local_mean"))


def block_mass(
    vectors: DataFrame, dim: int, block: int, stride: int, norm: float = 1.0, mode: str = "inverse",
    query: str = "vec", key: str = "vec", keys: tuple[str, ...] = ("seq_id",),
) -> DataFrame:
    """(keys, qb, kb, score): causal softmax mass between blocks, over strided groups.

    A group is ``stride`` positions side by side; with ``inverse`` the query side is
    read backwards inside its group. Blocks of one query meet blocks of earlier keys
    as tiles, one task row each; a tile holds block x block numbers at most, and a
    second pass over row maxima and sums makes the softmax exact.
    """
    if mode not in ("inverse", "slash"):
        raise ValueError(f"unknown mode: {mode}")
    if block % stride:
        raise ValueError("block must be a multiple of stride")
    groups = block // stride
    blocked = (
        vectors.groupBy(*keys, F.floor(F.col("pos") / block).cast("int").alias("blk"))
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.pmod("pos", F.lit(block)).alias("at"), F.col(query).alias("q"), F.col(key).alias("k")))
            ).alias("rows")
        )
        .select(
            *keys, "blk",
            F.transform("rows", lambda r: r["at"]).alias("at"),
            F.flatten(F.transform("rows", lambda r: r["q"])).alias("q"),
            F.flatten(F.transform("rows", lambda r: r["k"])).alias("k"),
        )
    )
    queries = blocked.select(
        *keys, F.col("blk").alias("qb"), F.col("at").alias("q_at"), "q", F.explode(F.sequence(F.lit(0), "blk")).alias("kb")
    )
    key_blocks = blocked.select(*keys, F.col("blk").alias("kb"), F.col("at").alias("k_at"), "k")
    scale = 1.0 / (np.sqrt(dim) * stride * norm)
    backwards = mode == "inverse"

    def matrix(at: np.ndarray, flat: np.ndarray, back: bool) -> np.ndarray:
        whole = np.zeros((groups * stride, dim))
        whole[np.asarray(at)] = np.asarray(flat).reshape(-1, dim)
        used = -(-(int(np.max(at)) + 1) // stride)
        whole = whole.reshape(groups, stride, dim)
        return (whole[:, ::-1] if back else whole).reshape(groups, stride * dim)[:used]

    parts = T.ArrayType(T.StructType([T.StructField("top", T.DoubleType()), T.StructField("sum", T.DoubleType())]))

    @F.pandas_udf(parts)
    def tile(
        same: pd.Series, q_at: pd.Series, q: pd.Series, k_at: pd.Series, k: pd.Series
    ) -> pd.Series:
        out = []
        for diagonal, qa, qv, ka, kv in zip(same, q_at, q, k_at, k):
            scores = matrix(qa, qv, backwards) @ matrix(ka, kv, False).T * scale
            if diagonal:
                scores[np.triu_indices_from(scores, 1)] = -np.inf
            top = scores.max(axis=1)
            total = np.exp(scores - top[:, None]).sum(axis=1)
            out.append([{"top": a, "sum": b} for a, b in zip(top.tolist(), total.tolist())])
        return pd.Series(out)

    tiles = queries.join(key_blocks, [*keys, "kb"]).select(
        *keys, "qb", "kb", tile(F.col("qb") == F.col("kb"), "q_at", "q", "k_at", "k").alias("t")
    )
    rows = tiles.select(*keys, "qb", "kb", F.posexplode("t").alias("r", "t"))
    line = Window.partitionBy(*keys, "qb", "r")
    raised = rows.withColumn("_top", F.max("t.top").over(line)).withColumn(
        "_e", F.col("t.sum") * F.exp(F.col("t.top") - F.col("_top"))
    )
    return (
        raised.withColumn("_share", F.col("_e") / F.sum("_e").over(line))
        .groupBy(*keys, "qb", "kb")
        .agg(F.sum("_share").alias("score"))
    )
