"""Streams of files: late rows are dropped, and a table may be a file or a folder."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import metrics
from sparkloom.streaming import jobs, ordered


def stream_of(spark, folder, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    folder = str(tmp_path / "in")
    schema = "ts timestamp, task string, value double"
    batches = [
        [(at(1, 5), "a", 1.0), (at(1, 50), "a", 3.0), (at(3, 30), "a", 9.0)],
        [(at(3, 40), "a", 5.0), (at(5, 0), "b", 2.0)],
        [(at(1, 10), "a", 100.0), (at(8, 0), "b", 1.0)],  # the first is late: its window was written before
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    source = stream_of(spark, folder, spark.read.parquet(folder).schema)
    got = {(r.window_start.hour, r.task): (r["mean"], r.samples) for r in jobs.drain(jobs.stream_task_means(source), "means").collect()}
    assert got == {(1, "a"): (2.0, 2), (3, "a"): (7.0, 2), (5, "b"): (2.0, 1)}


def test_a_table_may_be_a_folder(spark, tmp_path):
    rows = [(("a", "b")[i % 2], i, 10 * i, i % 50 == 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "run string, step long, t long, force boolean")
    frame.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    frame.coalesce(1).write.parquet(str(tmp_path / "aside"))
    (one,) = (tmp_path / "aside").glob("*.parquet")
    one.rename(tmp_path / "one.parquet")
    want = sorted((r.run, r.step, r.log_no) for r in metrics.rate_limited_log(frame, 55, max_steps=200).collect())
    for name in ("many.parquet", "one.parquet"):
        stream = jobs.read_table_stream(spark, str(tmp_path), name)
        timed = stream.withColumn("ts", F.timestamp_seconds(F.col("t") + 1))
        got = ordered.drain_in_order(timed, lambda s: ordered.ordered_rate_limit(s, 55, late="1 day", max_steps=200), "logged").collect()
        assert sorted((r.run, r.step, r.log_no) for r in got) == want
    with pytest.raises(Exception):
        jobs.read_table_stream(spark, str(tmp_path), "none.parquet")
