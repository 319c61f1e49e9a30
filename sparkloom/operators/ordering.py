"""Ordered work without a single-task window.

A frame is range-partitioned on its order once and checkpointed; each partition
is one *chunk*. Anything that depends on all earlier rows is then computed
inside the chunks plus a carry table with one row per chunk (and key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.session import cut

_ROW_MASK = (1 << 33) - 1


def ordered_chunks(df: DataFrame, *order, chunks: int | None = None) -> DataFrame:
    """Sort globally and freeze ``_chunk`` (partition) and ``_row`` (place inside it).

    ``order`` must be unique per row, so that a hot value is split over chunks.
    """
    ranged = df.repartitionByRange(chunks, *order) if chunks else df.repartitionByRange(*order)
    return cut(
        ranged.sortWithinPartitions(*order).select(
            "*",
            F.spark_partition_id().alias("_chunk"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)).alias("_row"),
        )
    )


def with_global_index(
    df: DataFrame, *order, name: str = "idx", total: str = "total", chunks: int | None = None
) -> DataFrame:
    """Add a dense 0-based index in the given order, and the number of rows.

    Only the chunk counts (one row per chunk) meet in one task and are broadcast.
    """
    return index_chunks(ordered_chunks(df, *order, chunks=chunks), name, total).drop("_chunk", "_row")


def index_chunks(chunked: DataFrame, name: str = "idx", total: str = "total") -> DataFrame:
    """The index of rows in ordered chunks; rows stay where they are."""
    counts = chunked.groupBy("_chunk").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(
        F.col("_chunk").alias("_c"),
        (F.sum("_n").over(upto) - F.col("_n")).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias(total),
    )
    return chunked.join(F.broadcast(offsets), F.col("_chunk") == F.col("_c")).select(
        *chunked.columns, (F.col("_base") + F.col("_row")).alias(name), total
    )


def running(
    df: DataFrame, keys: list[str], order: list, chunks: int | None = None, **outputs: tuple[str, str]
) -> DataFrame:
    """Running values over the rows of each key, in order: ``name=(kind, column)``.

    Kinds: ``sum`` and ``count`` (non-null rows so far), ``last`` (last non-null so
    far), ``prev`` (the row before) and ``first`` (first row of the key).
    """
    rows = ordered_chunks(df, *keys, *order, chunks=chunks)
    here = Window.partitionBy("_chunk", *keys).orderBy("_row")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carries = Window.partitionBy(*keys).orderBy("_chunk")
    before = carries.rowsBetween(Window.unboundedPreceding, -1)

    inside, totals, carried, final = [], [], [], []
    for name, (kind, column) in outputs.items():
        value, local, carry = F.col(column), f"_{name}_in", f"_{name}_carry"
        if kind in ("sum", "count"):
            agg = F.sum(value) if kind == "sum" else F.count(value)
            inside.append(agg.over(upto).alias(local))
            totals.append(agg.alias(carry))
            carried.append(F.sum(carry).over(before).alias(carry))
            # a sum is null until the first non-null row
            both = F.coalesce(F.col(local) + F.col(carry), F.col(local), F.col(carry))
        elif kind == "last":
            inside.append(F.last(value, ignorenulls=True).over(upto).alias(local))
            totals.append(F.max_by(value, F.when(value.isNotNull(), F.col("_row"))).alias(carry))
            carried.append(F.last(carry, ignorenulls=True).over(before).alias(carry))
            both = F.coalesce(local, carry)
        elif kind == "prev":
            inside.append(F.lag(value).over(here).alias(local))
            totals.append(F.max_by(value, "_row").alias(carry))
            carried.append(F.lag(carry).over(carries).alias(carry))
            lead_row = F.col("_first_row") == F.col("_row")
            both = F.when(lead_row, F.col(carry)).otherwise(F.col(local))
        elif kind == "first":
            inside.append(F.lit(None).alias(local))
            totals.append(F.min_by(value, "_row").alias(carry))
            carried.append(F.first(carry).over(carries).alias(carry))
            both = F.col(carry)
        else:
            raise ValueError(f"unknown running kind: {kind}")
        final.append(both.alias(name))

    per_chunk = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.min("_row").alias("_first_row"), *totals)
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_c"), "_first_row", *carried)
    )
    same: Column = F.col("_chunk") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.select("*", *inside).join(per_chunk, same).select(*df.columns, *final)


def sort_by_length(df: DataFrame, length: str = "length", tie: str = "item_id", chunks: int | None = None) -> DataFrame:
    """Global ascending length order with a tie key, as a dense ``idx``."""
    return with_global_index(df, length, tie, chunks=chunks)


def shard_of(idx: Column, total: Column, shards: int) -> Column:
    """Consecutive shards whose sizes differ by one at most; never more shards than rows."""
    n = F.greatest(F.lit(1), F.least(F.lit(shards), total))
    extra = total % n
    size = ((total - extra) / n).cast("bigint")
    head = extra * (size + 1)
    return (
        F.when(idx < head, F.floor(idx / (size + 1)))
        .otherwise(extra + F.floor((idx - head) / F.greatest(size, F.lit(1))))
        .cast("int")
    )


def contiguous_shards(df: DataFrame, *order, shards: int = 32, chunks: int | None = None) -> DataFrame:
    """Split the ordered rows into consecutive shards."""
    indexed = with_global_index(df, *order, chunks=chunks)
    return indexed.withColumn("shard", shard_of(F.col("idx"), F.col("total"), shards)).drop("total")


def shuffle_key(seed: int, *ids: str) -> Column:
    """A repeatable random order: md5 of the seed and the row's ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def replica_shards(
    df: DataFrame, row_id: str, world: int, sequence_parallel: int = 1, seed: int = 42, chunks: int | None = None
) -> DataFrame:
    """Seeded shuffle; replica r takes places r, r+R, ...; the uneven tail is dropped."""
    replicas = world // sequence_parallel
    mixed = with_global_index(
        df.withColumn("_mix", shuffle_key(seed, row_id)), "_mix", row_id, chunks=chunks
    ).drop("_mix")
    even = F.floor(F.col("total") / replicas) * replicas
    return mixed.filter(F.col("idx") < even).select(
        *df.columns,
        F.pmod("idx", F.lit(replicas)).cast("int").alias("replica"),
        F.floor(F.col("idx") / replicas).alias("place"),
    )


def replica_shards_eval(
    df: DataFrame, *order, world: int, sequence_parallel: int = 1, chunks: int | None = None
) -> DataFrame:
    """Input order, tail kept: rows from the start are repeated until all replicas are even."""
    replicas = world // sequence_parallel
    indexed = with_global_index(df, *order, chunks=chunks)
    padded = F.ceil(F.col("total") / replicas) * replicas
    copies = F.sequence(F.lit(0), F.floor((padded - 1 - F.col("idx")) / F.col("total")).cast("int"))
    return (
        indexed.withColumn("_copy", F.explode(copies))
        .withColumn("_place", F.col("idx") + F.col("_copy") * F.col("total"))
        .select(
            *df.columns,
            F.col("_place").alias("eval_idx"),
            F.pmod("_place", F.lit(replicas)).cast("int").alias("replica"),
            F.floor(F.col("_place") / replicas).alias("place"),
            (F.col("_copy") > 0).alias("is_padding"),
        )
    )


def micro_batches(df: DataFrame, batch: int, place: str = "idx") -> DataFrame:
    """Groups of ``batch`` consecutive rows; the last may be short."""
    return df.withColumn("micro_batch", F.floor(F.col(place) / batch))


def accumulation_steps(batch: int, per_device: int, gpus: int, nodes: int) -> int:
    """Micro-batches per optimizer step."""
    return batch // per_device // gpus // nodes


def consumed_samples(step: int, batch: int, world: int, accumulation: int, replication: int | None = None) -> int:
    """Rows read so far by all replicas."""
    seen = step * batch * world * accumulation
    return seen // replication if replication is not None else seen


def resume_offset(df: DataFrame, *order, consumed: int, chunks: int | None = None) -> DataFrame:
    """Rows still to be read after ``consumed`` rows of the stable order."""
    return with_global_index(df, *order, chunks=chunks).filter(F.col("idx") >= consumed).drop("total")


def restore_order(df: DataFrame, seq_id: str = "seq_id", chunks: int | None = None) -> DataFrame:
    """Results in submission order, with their place."""
    return with_global_index(df, seq_id, name="place", chunks=chunks).drop("total")
