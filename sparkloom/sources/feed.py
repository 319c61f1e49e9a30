"""Feeding samples in a stable order as a stream that resumes, and sinks that write a batch once.

A feed table is written with the place of every sample, in folders of consecutive places. A streaming source hands out places: its
offset is the number of samples consumed, and lies in the query's checkpoint. Every batch reads only the folders that
its places fall in. Only places pass through the source; samples are read by executors, from any file system.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from sparkloom.operators.ordering import with_global_index
from sparkloom.sources.pack_cache import metrics_json

FOLDER = "feed_block"


class Places(DataSource):
    """Rows (first, stop) of places to be read; options ``total``, ``start`` and ``batch``."""

    @classmethod
    def name(cls) -> str:
        return "sample_places"

    def schema(self) -> str:
        return "first long, stop long"

    def simpleStreamReader(self, schema) -> "_PlacesReader":
        return _PlacesReader(self.options)


class _PlacesReader(SimpleDataSourceStreamReader):
    """One range per batch; the end of the table is where no more follow."""

    def __init__(self, options) -> None:
        self.total, self.start, self.batch = (int(options[name]) for name in ("total", "start", "batch"))

    def initialOffset(self) -> dict:
        return {"consumed": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["consumed"]
        stop = min(self.total, first + self.batch)
        rows = [(first, stop)] if first < stop else []
        return iter(rows), {"consumed": max(first, stop)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["consumed"], end["consumed"])])


def write_feed(samples: DataFrame, path: str, *order, block: int = 1 << 16, place: str = "idx") -> int:
    """Write samples with their place in the order, ``block`` consecutive places a folder; returns their number."""
    indexed = with_global_index(samples, *order, name=place).drop("total")
    blocked = indexed.withColumn(FOLDER, F.floor(F.col(place) / block))
    # rows of one folder lie in consecutive chunks already: each task writes few folders
    blocked.write.partitionBy(FOLDER).parquet(path)
    return samples.sparkSession.read.schema(blocked.schema).parquet(path).count()


def read_places(spark: SparkSession, path: str, first: int, stop: int, block: int = 1 << 16, place: str = "idx") -> DataFrame:
    """Samples from ``first`` up to ``stop``; only the folders between are read."""
    folders = F.col(FOLDER).between(first // block, max(first, stop - 1) // block)
    return spark.read.parquet(path).filter(folders & (F.col(place) >= first) & (F.col(place) < stop)).drop(FOLDER)


def run_feed(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    consume: Callable[[DataFrame, int], None],
    total: int,
    batch: int,
    start: int = 0,
    block: int = 1 << 16,
    place: str = "idx",
) -> int:
    """Hand the samples of a feed table to ``consume``, batch by batch, until there are no more; returns how many this call handed out.

    ``consume(samples, batch_id)`` is called once per batch, and again with the same rows and the same id when the run ended
    before the batch was done; a sink of :func:`write_batches` makes that once. A later call with the same checkpoint
    goes on after the last batch that was done, whatever ``start`` it is given.
    """
    spark.dataSource.register(Places)
    places = spark.readStream.format(Places.name()).options(total=str(total), start=str(start), batch=str(batch)).load()

    handed: list[int] = []

    def one(ranges: DataFrame, batch_id: int) -> None:
        for first, stop in ranges.collect():  # one range a batch
            if first == stop:
                continue
            consume(read_places(spark, path, first, stop, block, place), batch_id)
            handed.append(stop - first)

    query = places.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sum(handed)


def write_batches(path: str, kind: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: a batch has a folder of its own, which a repeated batch replaces. So every row is there once."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.format(kind).mode("overwrite").save(f"{path.rstrip('/')}/batch_id={batch_id}")

    return write


def stream_metrics_json(
    metrics: DataFrame, path: str, checkpoint: str, step: str = "step", name: str = "metric", value: str = "value"
) -> None:
    """Emit a stream of metrics as one JSON object per step and batch, over all input there is.

    The stream must emit a step's metrics in one batch, as closed windows do. Files of a batch that is run again are replaced.
    """
    write = write_batches(path, "text")

    def one(rows: DataFrame, batch_id: int) -> None:
        write(metrics_json(rows, step, name, value).select("json"), batch_id)

    query = metrics.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
