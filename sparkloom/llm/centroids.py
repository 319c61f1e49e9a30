"""Centroid clustering with sharded dimensions: Lloyd's rounds on blocks of columns.

Vectors become whole numbers, so that distances and means are exact and reruns agree. They are cut into chunks of rows, and
the columns of a chunk into blocks. A block's tasks hold its columns and the matching slices of the centroids. In a
round each task works out the exact partial squared distances of its chunk; the partial sums of a chunk's blocks are added where they
meet, by chunk, and give every vector its nearest centroid. The choices, one byte or two a vector, go back to the blocks, each of
which adds up its own columns and moves its own slices. Only distances and choices travel: the columns are dealt once
and stay, and slices come to the driver, whose size is that of the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.common import require
from sparkloom.llm.whitening import whole_numbers
from sparkloom.session import stage

_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)
_SIGNED = (np.int8, np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Lloyd:
    """Vectors of ``dimension`` entries; entry x becomes floor(scale * x). ``rounds`` of ``clusters`` centroids.

    Columns are dealt to tasks in blocks of ``block_columns``, rows in chunks of ``chunk_rows``.
    """

    dimension: int = 64
    clusters: int = 8
    rounds: int = 10
    scale: float = 1024.0
    seed: int = 3
    block_columns: int = 32
    chunk_rows: int = 4096

    @property
    def blocks(self) -> int:
        return -(-self.dimension // self.block_columns)

    @property
    def most(self) -> float:
        """Entries below this give squared distances below 2**62."""
        return float(int((2.0**60 / self.dimension) ** 0.5))


def _packed(values: np.ndarray, kinds=_KINDS) -> bytes:
    """Whole numbers in as few bytes as do; the first byte says how many."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    place = next(k for k, t in enumerate(kinds) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([place]) + values.astype(kinds[place]).tobytes()


def _unpacked(data, kinds=_KINDS) -> np.ndarray:
    return np.frombuffer(data, kinds[memoryview(data)[0]], -1, 1).astype(np.int64)


def _columns(rule: Lloyd):
    """Batches of (id, vector) to (block, chunk, ids, columns): a row per chunk and block; ids come with block 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1), rule.scale, rule.most):
                if x.shape[1] != rule.dimension:
                    continue
                for first in range(0, len(rows), rule.chunk_rows):
                    part = slice(first, first + rule.chunk_rows)
                    ids = pa.array([batch.column(0).take(pa.array(rows[part])).to_pylist()] + [None] * (rule.blocks - 1), pa.list_(pa.int64()))
                    slices = [x[part, c : c + rule.block_columns] for c in range(0, rule.dimension, rule.block_columns)]
                    yield pa.record_batch(
                        [
                            pa.array(range(rule.blocks), pa.int32()),
                            pa.array([chunk] * rule.blocks, pa.int64()),
                            ids,
                            pa.array([_packed(s, _SIGNED) for s in slices], pa.binary()),
                        ],
                        names=["block", "chunk", "ids", "columns"],
                    )
                    chunk += 1

    return run


def _distances(rule: Lloyd, centroids: np.ndarray, with_ids: bool):
    """Batches of (block, chunk, ids, columns) to (chunk, ids, partial): squared distances to the slices of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, columns in zip(batch.column("block").to_pylist(), batch.column("columns").to_pylist()):
                own = centroids[:, block * rule.block_columns : (block + 1) * rule.block_columns]
                x = _unpacked(columns, _SIGNED).reshape(-1, own.shape[1])
                out.append(_packed(np.stack([((x - c) ** 2).sum(axis=1) for c in own], axis=1)))
            columns = [batch.column("chunk"), pa.array(out, pa.binary())]
            names = ["chunk", "partial"]
            if with_ids:
                columns, names = [*columns, batch.column("ids")], [*names, "ids"]
            yield pa.record_batch(columns, names=names)

    return run


def _chunks(batches: Iterator[pa.RecordBatch], clusters: int) -> Iterator[tuple[int, np.ndarray, list | None]]:
    """(chunk, distances, ids) from rows in chunk order: the partial distances of its blocks, added."""
    key, total, ids = None, None, None
    for batch in batches:
        held = batch.column("ids").to_pylist() if "ids" in batch.schema.names else [None] * batch.num_rows
        for chunk, partial, own in zip(batch.column("chunk").to_pylist(), batch.column("partial").to_pylist(), held):
            found = _unpacked(partial).reshape(-1, clusters)
            if chunk != key:
                if key is not None:
                    yield key, total, ids
                key, total, ids = chunk, found, None
            else:
                total = total + found
            ids = own if own is not None else ids
    if key is not None:
        yield key, total, ids


def _choices(rule: Lloyd, clusters: int):
    """Rows (chunk, partial) in chunk order to (block, chunk, choices), for every block: the nearest, ties to the smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, total, _ in _chunks(batches, clusters):
            choices = _packed(total.argmin(axis=1))
            yield pa.record_batch(
                [
                    pa.array(range(rule.blocks), pa.int32()),
                    pa.array([chunk] * rule.blocks, pa.int64()),
                    pa.array([choices] * rule.blocks, pa.binary()),
                ],
                names=["block", "chunk", "choices"],
            )

    return run


def _moves(rule: Lloyd, clusters: int):
    """Batches of (block, columns, choices) to (cluster, place, total, n): sums of the columns of a block in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((clusters, rule.dimension), np.int64)
        counts = np.zeros((clusters, rule.dimension), np.int64)
        for batch in batches:
            for block, columns, chosen in zip(*(batch.column(c).to_pylist() for c in ("block", "columns", "choices"))):
                own = slice(block * rule.block_columns, min((block + 1) * rule.block_columns, rule.dimension))
                x, choices = _unpacked(columns, _SIGNED).reshape(-1, own.stop - own.start), _unpacked(chosen)
                for cluster in np.unique(choices).tolist():
                    mine = x[choices == cluster]
                    totals[cluster, own] += mine.sum(axis=0)
                    counts[cluster, own] += len(mine)
        cluster, place = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(cluster), pa.array(place), pa.array(totals[cluster, place]), pa.array(counts[cluster, place])],
            names=["cluster", "place", "total", "n"],
        )

    return run


def first_centroids(rows: DataFrame, rule: Lloyd, id_col: str, vector: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:id``, in that order; equal ids by their entries.

    At most ``clusters`` vectors come to the driver.
    """
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kept = kept.filter(_is_kept(rule, F.col("v")) & F.col("id").isNotNull())
    order = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.col("id").cast("string")), 256)
    chosen = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(rule.clusters).collect()
    return np.floor(np.array([r["v"] for r in chosen]).reshape(-1, rule.dimension) * rule.scale).astype(np.int64)


def _is_kept(rule: Lloyd, vector: Column) -> Column:
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * rule.scale)) < rule.most))
    return F.coalesce((F.size(vector) == rule.dimension) & fits, F.lit(False))


@dataclass
class Clusters:
    """``rows`` is (``id_col``, cluster, distance), a written table; ``centroids`` are whole numbers."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(rows: DataFrame, rule: Lloyd = Lloyd(), id_col: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Lloyd's rounds, then one more choice of the nearest centroid for every vector.

    A round replaces every centroid that vectors have chosen by floor(sum / count) of these, entry by entry; others stay.
    Ties go to the smaller number. Rounds end early when no centroid moved, since all later ones would be the same.

    Defined results: vectors that are null, have another length than ``dimension``, hold a null, NaN or infinite
    entry, or one whose whole number is so large that a distance may exceed 62 bits (2**27 for 64 entries),
    take no part. Fewer vectors than ``clusters`` give fewer centroids. Rows with a null id are given clusters, but are no first
    centroids; if all ids are null there is no centroid, and no rows come out. Repeated rows count and come out as often
    as they stand; other columns are not read. An empty table gives no rows. Ids are integers. Jobs run when this is
    called, and the table is read twice.
    """
    require(rows, id_col, vector)
    spark = rows.sparkSession
    centroids = first_centroids(rows, rule, id_col, vector)
    k, result = len(centroids), f"{id_col} long, cluster int, distance long"
    if not k:
        return Clusters(spark.createDataFrame([], result), centroids)
    pairs = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    schema = "block int, chunk long, ids array<long>, columns binary"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt once; joins of later plans know the partitioning of a kept table only when it has been filled
    columns = pairs.mapInArrow(_columns(rule), schema).repartition(width, "block", "chunk").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        columns.count()
        for _ in range(rule.rounds):
            partial = columns.mapInArrow(_distances(rule, centroids, False), "chunk long, partial binary")
            choices = partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
                _choices(rule, k), "block int, chunk long, choices binary"
            )
            moved = columns.select("block", "chunk", "columns").join(choices.hint("shuffle_hash"), ["block", "chunk"])
            sums = moved.mapInArrow(_moves(rule, k), "cluster long, place long, total long, n long").groupBy("cluster", "place").agg(
                F.sum("total").alias("total"), F.sum("n").alias("n")
            )
            after = centroids.copy()
            for r in sums.collect():  # one row per entry of the centroids
                after[r["cluster"], r["place"]] = r["total"] // r["n"]
            if (after == centroids).all():
                break
            centroids = after
        partial = columns.mapInArrow(_distances(rule, centroids, True), "chunk long, partial binary, ids array<long>")
        found = partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_assigned(k, id_col), result)
        return Clusters(stage(found, "clusters"), centroids)
    finally:
        columns.unpersist()


def _assigned(clusters: int, id_col: str):
    """Rows (chunk, partial, ids) in chunk order to a row per vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, total, ids in _chunks(batches, clusters):
            nearest = total.argmin(axis=1)
            distance = total[np.arange(len(total)), nearest]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(nearest, pa.int32()), pa.array(distance)], names=[id_col, "cluster", "distance"]
            )

    return run


def cluster_report(found: Clusters) -> DataFrame:
    """``found.rows`` with cluster_inertia, inertia and centroid_sha256: a digest of the centroid's decimal entries.

    The sums are null where they have more than 64 bits.
    """
    per_cluster = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = sum(int(r["s"]) for r in per_cluster)
    facts = []
    for r in per_cluster:  # one row per centroid
        name = hashlib.sha256(",".join(map(str, found.centroids[r["cluster"]].tolist())).encode()).hexdigest()
        facts.append((r["cluster"], *[v if v < 1 << 63 else None for v in (int(r["s"]), inertia)], name))
    table = found.rows.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.rows.join(F.broadcast(table), "cluster").select(*found.rows.columns, *table.columns[1:])
