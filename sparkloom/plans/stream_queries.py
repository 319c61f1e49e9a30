"""Streaming queries: each drains the files that are there and returns what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.operators import packing
from sparkloom.plans import views as v
from sparkloom.plans.batch_queries import CONFIG, PACK_SQL, PACKED_SQL, pack_view
from sparkloom.plans.metric_queries import INTERVAL, LOGGED_SQL
from sparkloom.plans.registry import query
from sparkloom.session import stage_path
from sparkloom.sources import feed
from sparkloom.streaming import jobs, ordered

CLOSED_SQL = f"""{v.METRIC_ROWS_SQL}, hours AS (
  SELECT date_trunc('hour', ts) AS window_start, step, task, avg(value) AS mean, count(*) AS samples
  FROM metric_rows GROUP BY 1, 2, 3),
closed AS (SELECT * FROM hours
  WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""


def _task_means(spark: SparkSession, sf: str) -> DataFrame:
    """Closed windows of the event stream; wall-clock times are taken as UTC."""
    events = jobs.read_table_stream(spark, sf, "events.parquet").select(
        F.timestamp_micros(v.epoch_micros(F.col("ts"))).alias("ts"), F.col("event_type").alias("task"), F.round(F.col("value") * 100).alias("value")
    )
    return jobs.stream_task_means(events)


def _hour() -> Column:
    origin = v.epoch_micros(F.lit(v.ORIGIN))
    return F.floor((F.unix_micros("window_start") - origin) / 3_600_000_000)


@query(
    "stream_task_means",
    f"WITH {CLOSED_SQL} SELECT step, task, round(mean, 6) AS mean, samples FROM closed",
)
def stream_task_means(spark: SparkSession, sf: str) -> DataFrame:
    means = jobs.drain(_task_means(spark, sf), "task-means")
    return means.select(_hour().alias("step"), "task", F.round("mean", 6).alias("mean"), "samples")


@query(
    "stream_last_known",
    f"""WITH {CLOSED_SQL}, grid AS (SELECT s.step, t.task FROM (SELECT DISTINCT step FROM closed) s
      JOIN (SELECT task, min(step) AS first_step FROM closed GROUP BY 1) t ON s.step >= t.first_step)
    SELECT 'events' AS run, step, task, round(last_value(mean IGNORE NULLS) OVER (PARTITION BY task ORDER BY step), 6) AS value,
      mean IS NULL AS carried FROM grid LEFT JOIN closed USING (task, step)""",
)
def stream_last_known(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means of the event stream as the metrics of one run: a row per task and hour, few whatever the events."""
    means = _task_means(spark, sf)
    path = jobs.drain_to_path(means, "closed")
    closed = spark.readStream.schema(means.schema).parquet(path).select(
        F.lit("events").alias("run"), F.col("window_start").alias("ts"), _hour().alias("step"), "task", F.col("mean").alias("value")
    )
    filled = ordered.drain_in_order(closed, lambda s: ordered.ordered_last_known(s, late="1 day"), "last-known")
    return filled.withColumn("value", F.round("value", 6))


@query(
    "stream_rate_limit",
    f"""WITH {LOGGED_SQL} SELECT run, step, t, row_number() OVER (PARTITION BY run ORDER BY rn) - 1 AS log_no FROM fold WHERE logged""",
)
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    steps = v.table(spark, sf, "events").count()
    events = jobs.read_table_stream(spark, sf, "events.parquet")
    rows = v.progress_columns(events).drop("tokens").withColumn("ts", F.timestamp_micros("t"))
    logged = ordered.drain_in_order(rows, lambda s: ordered.ordered_rate_limit(s, INTERVAL, late="7 days", max_steps=steps), "logged")
    return logged.select("run", "step", "t", "log_no")


PACK, PACK_SHARDS = 2048, 8


@query(
    "stream_pack",
    f"""WITH RECURSIVE {v.REQUESTS_SQL},
    q AS MATERIALIZED (SELECT seq_id, n, seq_id % {PACK_SHARDS} AS shard,
      row_number() OVER (PARTITION BY seq_id % {PACK_SHARDS} ORDER BY seq_id) AS rn FROM requests WHERE n <= {PACK}),
    fold(shard, rn, seq_id, n, used, pack_no) AS (
      SELECT shard, rn, seq_id, n, n, 0 FROM q WHERE rn = 1
      UNION ALL
      SELECT q.shard, q.rn, q.seq_id, q.n, CASE WHEN f.used + q.n <= {PACK} THEN f.used + q.n ELSE q.n END,
        CASE WHEN f.used + q.n <= {PACK} THEN f.pack_no ELSE f.pack_no + 1 END
      FROM fold f JOIN q ON q.shard = f.shard AND q.rn = f.rn + 1)
    SELECT CAST(shard AS INTEGER) AS shard, seq_id, n, pack_no FROM fold""",
)
def stream_pack(spark: SparkSession, sf: str) -> DataFrame:
    docs = jobs.read_table_stream(spark, sf, "documents.parquet")
    sizes = docs.select(
        F.pmod("doc_id", F.lit(PACK_SHARDS)).cast("int").alias("shard"),
        F.col("doc_id").alias("seq_id"),
        F.size(v.words(F.col("text"))).alias("n"),
        F.timestamp_seconds(F.col("doc_id") + 1).alias("ts"),
    ).filter(F.col("n") <= PACK)
    numbered = ordered.drain_in_order(sizes, lambda s: ordered.ordered_pack_numbers(s, PACK, late="30 days", order="seq_id"), "packs")
    return numbered.select("shard", "seq_id", "n", "pack_no")


@query("stream_pack_rows", f"WITH {PACKED_SQL} {PACK_SQL}")
def stream_pack_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole packs out of a stream of samples in files of no order, the last pack of each shard included."""
    items = v.sft_items(spark, sf)
    samples = packing.staged_samples(items, CONFIG)
    places = packing.assign_packs(items, samples, CONFIG).select("item_id", "shard", "idx")
    arrived = samples.join(places, "item_id").withColumn("ts", F.timestamp_seconds(F.col("idx") + 1)).drop("item_id")
    path = stage_path(spark, "arrived")
    arrived.repartition(4, F.xxhash64("idx")).write.parquet(path)
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 1).parquet(path)
    packs = ordered.drain_in_order(stream, lambda s: ordered.ordered_packs(s, CONFIG.max_len, late="30 days"), "packs")
    return pack_view(ordered.pack_rows(packs))


@query(
    "stream_metrics_json",
    f"WITH {CLOSED_SQL} SELECT CAST(step AS BIGINT) AS step, task AS metric, round(mean, 6) AS value FROM closed",
)
def stream_metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object per closed hour, by a sink that writes every batch once."""
    means = _task_means(spark, sf).select(_hour().alias("step"), "task", F.round("mean", 6).alias("mean"))
    path = stage_path(spark, "metrics-json")
    feed.stream_metrics_json(means, path, f"{path}-checkpoint", "step", "task", "mean")
    lines = spark.read.schema("value string").text(path).select(F.from_json("value", "map<string,double>").alias("j"))
    pairs = lines.select(F.col("j")["step"].cast("bigint").alias("step"), F.explode("j").alias("metric", "value"))
    return pairs.filter("metric != 'step'")


FEED_START, FEED_BATCH = 100, 250


@query(
    "stream_resume_feed",
    f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS idx FROM documents)
    SELECT doc_id, idx, (idx - {FEED_START}) // {FEED_BATCH} AS batch FROM o WHERE idx >= {FEED_START}""",
)
def stream_resume_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by length, after a number of consumed ones, in batches, each written once."""
    docs = v.table(spark, sf, "documents").select("doc_id", "n_chars")
    path, out = stage_path(spark, "feed"), stage_path(spark, "fed")
    total = feed.write_feed(docs, path, "n_chars", "doc_id", block=1000)
    batch = max(FEED_BATCH, -(-total // 20) // FEED_BATCH * FEED_BATCH)
    feed.run_feed(spark, path, f"{out}-checkpoint", feed.write_batches(out), total, batch, FEED_START, block=1000)
    fed = spark.read.parquet(out)
    return fed.select("doc_id", "idx", F.floor((F.col("idx") - FEED_START) / FEED_BATCH).alias("batch"))
