"""Streams of files: reading, draining into files, and windowed means. Operators with state are in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.session import stage_path
from sparkloom.sources.corpus import has_parquet, is_file


def read_table_stream(spark: SparkSession, folder: str, name: str, max_bytes: int = 1 << 30) -> DataFrame:
    """One table in a folder as a stream: a single file, or a folder of part files. No file at all is an error.

    Its schema is that of the files. ``max_bytes`` per batch bounds what one hot key can bring to its task.
    """
    path = f"{folder}/{name}"
    if not has_parquet(spark, path):
        raise ValueError(f"no parquet files found in {path}")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", max_bytes)
    if is_file(spark, path):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path)


def drain_to_path(stream: DataFrame, name: str, path: str | None = None) -> str:
    """Run a stream over all input there is, into files of the shared folder.

    Output and checkpoint lie there, so a lost executor or driver resumes from the
    last finished batch. With the ``path`` of an earlier call the stream goes on where that one ended.
    """
    path = path or stage_path(stream.sparkSession, name)
    job = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    job.awaitTermination()
    return path


def drain(stream: DataFrame, name: str) -> DataFrame:
    """:func:`drain_to_path`, read back."""
    return stream.sparkSession.read.schema(stream.schema).parquet(drain_to_path(stream, name))


def stream_task_means(
    rows: DataFrame, time: str = "ts", task: str = "task", value: str = "value", window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Mean and count per task and time window, emitted once when the watermark closes it."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), task)
        .agg(F.avg(value).alias("mean"), F.count("*").alias("samples"))
        .select(F.col("w.start").alias("window_start"), task, "mean", "samples")
    )
