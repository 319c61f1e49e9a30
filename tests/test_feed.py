"""Feeds that resume and sinks that write once, with runs that end between batches."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.session import stage_path
from sparkloom.sources import feed
from sparkloom.streaming import jobs


def table(spark, rows=95):
    return spark.createDataFrame([(f"s{k}", (k * 37) % rows) for k in range(rows)], "name string, length long").repartition(3)


class Killed(Exception):
    pass


def fed(spark, path):
    return sorted((r.batch_id, r.idx, r.name, r.length) for r in spark.read.parquet(path).collect())


def test_feed_in_order_from_an_offset(spark, tmp_path):
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    total = feed.write_feed(table(spark), path, "length", "name", block=16)
    assert total == 95
    handed = feed.run_feed(spark, path, str(tmp_path / "cp"), feed.write_batches(out), total, batch=20, start=30, block=16)
    assert handed == 65
    want = [(b, k) for b, first in enumerate(range(30, 95, 20)) for k in range(first, min(95, first + 20))]
    rows = fed(spark, out)
    assert [(b, k) for b, k, _, _ in rows] == want
    assert all(length == k for _, k, _, length in rows)


@pytest.mark.parametrize("after_write", [False, True])
def test_a_run_that_is_killed_resumes(spark, tmp_path, after_write):
    """No row is lost or doubled, whether the run ends before or after its batch was written."""
    path, out, checkpoint = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "cp")
    total = feed.write_feed(table(spark), path, "length", "name", block=16)
    write, seen = feed.write_batches(out), []

    def failing(rows, batch_id):
        if batch_id == 2:
            if after_write:
                write(rows, batch_id)
            raise Killed
        write(rows, batch_id)

    def counting(rows, batch_id):
        seen.append(batch_id)
        write(rows, batch_id)

    with pytest.raises(Exception):
        feed.run_feed(spark, path, checkpoint, failing, total, batch=20, block=16)
    assert {b for b, *_ in fed(spark, out)} == ({0, 1, 2} if after_write else {0, 1})
    feed.run_feed(spark, path, checkpoint, counting, total, batch=20, block=16)
    assert seen == [2, 3, 4]  # batches that were done are not read again
    rows = fed(spark, out)
    assert [(b, k) for b, k, _, _ in rows] == [(k // 20, k) for k in range(95)]
    # nothing is left to read
    feed.run_feed(spark, path, checkpoint, counting, total, batch=20, block=16)
    assert seen == [2, 3, 4]


def test_only_the_folders_of_a_batch_are_read(spark, tmp_path):
    path = str(tmp_path / "feed")
    feed.write_feed(table(spark), path, "length", "name", block=16)
    read = feed.read_places(spark, path, 20, 40, block=16)
    assert sorted(r.idx for r in read.collect()) == list(range(20, 40))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(feed_block" in plan
    assert feed.read_places(spark, path, 40, 40, block=16).collect() == []


def test_empty_feed(spark, tmp_path):
    path = str(tmp_path / "feed")
    assert feed.write_feed(table(spark).filter("false"), path, "length", "name") == 0
    feed.run_feed(spark, path, str(tmp_path / "cp"), lambda rows, k: pytest.fail("no batch"), 0, batch=10)


def test_json_of_a_stream_is_there_once(spark, tmp_path):
    """A batch that failed after it was written is replaced, not added to."""
    schema, folder = "step long, metric string, value double", str(tmp_path / "in")
    for first in (0, 5):
        rows = [(s, m, s + 0.5) for s in range(first, first + 5) for m in ("a", "b")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    write = feed.write_batches(out, "text")

    def failing(rows, batch_id):
        write(rows.select(F.lit("half a batch").alias("json")), batch_id)
        raise Killed

    query = stream.writeStream.foreachBatch(failing).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(Exception):
        query.awaitTermination()
    feed.stream_metrics_json(stream, out, checkpoint)
    lines = [json.loads(r.value) for r in spark.read.schema("value string").text(out).collect()]
    assert sorted(lines, key=lambda x: x["step"]) == [{"step": float(s), "a": s + 0.5, "b": s + 0.5} for s in range(10)]


def test_drain_goes_on_where_it_ended(spark, tmp_path):
    schema, folder = "k long", str(tmp_path / "in")
    spark.createDataFrame([(1,)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    path = jobs.drain_to_path(stream, "rows")
    spark.createDataFrame([(2,)], schema).coalesce(1).write.mode("append").parquet(folder)
    assert jobs.drain_to_path(stream, "rows", path) == path
    assert sorted(r.k for r in spark.read.schema(schema).parquet(path).collect()) == [1, 2]
    assert stage_path(spark, "rows") != path
