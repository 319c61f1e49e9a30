"""Queries over run metrics, schedules and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions import schedules, text
from sparkloom.operators import metrics as m, ordering
from sparkloom.plans import views as v
from sparkloom.plans.registry import query
from sparkloom.session import stage_path
from sparkloom.sources import pack_cache

r6 = lambda c: F.round(c, 6)


@query("scalar_means", "SELECT props AS metric, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def scalar_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events").select(F.col("props").alias("metric"), "value")
    return m.scalar_means(rows).select("metric", r6("mean").alias("mean"))


@query(
    "task_means",
    f"""WITH {v.METRIC_ROWS_SQL} SELECT step, task, round(avg(value), 6) AS value, round(avg(value % 100), 6) AS part,
    round(avg(rank), 6) AS rank, count(*) AS samples FROM metric_rows GROUP BY step, task""",
)
def task_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.metric_rows(spark, sf).withColumn("part", F.pmod("value", F.lit(100.0)))
    measures = ("value", "part", "rank")
    means = m.task_means(rows, measures, "step", "task")
    return means.select("step", "task", *[r6(c).alias(c) for c in measures], "samples")


@query(
    "rank_merge",
    f"WITH {v.METRIC_ROWS_SQL} SELECT step, task, round(avg(value), 6) AS mean, count(*) AS n FROM metric_rows GROUP BY step, task",
)
def rank_merge(spark: SparkSession, sf: str) -> DataFrame:
    partials = m.rank_partials(v.metric_rows(spark, sf), "step", "task", "rank")
    return m.rank_merge(partials, "step", "task").select("step", "task", r6("mean").alias("mean"), "n")


@query(
    "last_known_fill",
    f"""WITH {v.METRIC_ROWS_SQL}, means AS (SELECT step, task, avg(value) AS value FROM metric_rows GROUP BY 1, 2),
    grid AS (SELECT s.step, t.task FROM (SELECT DISTINCT step FROM means) s
             JOIN (SELECT task, min(step) AS first_step FROM means GROUP BY 1) t ON s.step >= t.first_step)
    SELECT step, task, round(last_value(value IGNORE NULLS) OVER (PARTITION BY task ORDER BY step), 6) AS value,
           value IS NULL AS carried FROM grid LEFT JOIN means USING (step, task)""",
)
def last_known_fill(spark: SparkSession, sf: str) -> DataFrame:
    means = m.task_means(v.metric_rows(spark, sf), ("value",), "step", "task").select("step", "task", "value")
    return m.last_known_fill(means).withColumn("value", r6("value"))


@query(
    "running_mean",
    f"""WITH {v.METRIC_ROWS_SQL}, s AS (SELECT step, rank, sum(value) AS total FROM metric_rows GROUP BY 1, 2),
    p AS (SELECT step, avg(total) AS value FROM s GROUP BY 1)
    SELECT step, round(value, 8) AS value, round(avg(value) OVER (ORDER BY step), 8) AS running_mean FROM p""",
)
def running_mean(spark: SparkSession, sf: str) -> DataFrame:
    ranks = v.metric_rows(spark, sf).groupBy("step", "rank").agg(F.sum("value").alias("total"))
    steps = ranks.groupBy("step").agg(F.avg("total").alias("value"))
    return m.running_mean(steps).select("step", F.round("value", 8).alias("value"), F.round("running_mean", 8).alias("running_mean"))


INTERVAL = 6 * 3600 * 1_000_000

LOGGED_SQL = f"""RECURSIVE {v.PROGRESS_ROWS_SQL},
  seen AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t, step) AS rn,
      sum(tokens) OVER (PARTITION BY run ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS tokens_seen,
      force OR step >= (SELECT count(*) FROM events) - 1 AS must FROM progress_rows),
  fold(run, rn, step, t, tokens_seen, last_t, logged) AS (
    SELECT run, rn, step, t, tokens_seen, t, must FROM seen WHERE rn = 1
    UNION ALL
    SELECT s.run, s.rn, s.step, s.t, s.tokens_seen, CASE WHEN s.t - f.last_t > {INTERVAL} OR s.must THEN s.t ELSE f.last_t END,
           s.t - f.last_t > {INTERVAL} OR s.must
    FROM fold f JOIN seen s ON s.run = f.run AND s.rn = f.rn + 1)"""


@query(
    "rate_limited_log",
    f"""WITH {LOGGED_SQL} SELECT run, step, t, row_number() OVER (PARTITION BY run ORDER BY rn) - 1 AS log_no FROM fold WHERE logged""",
)
def rate_limited_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.progress_rows(spark, sf)
    steps = v.table(spark, sf, "events").count()
    return m.rate_limited_log(rows.drop("tokens"), INTERVAL, steps).select("run", "step", "t", "log_no")


@query(
    "progress_log",
    f"""WITH {LOGGED_SQL}, total AS (SELECT count(*) AS max_steps FROM events),
    starts AS (SELECT run, t AS start_t, step AS start_step, tokens_seen AS start_tokens FROM seen WHERE rn = 1),
    p AS (SELECT f.run, f.step, f.t, s.start_t, s.start_step, greatest(f.step, 1) AS done,
        (f.t - coalesce(lag(f.t) OVER w, s.start_t)) / 1e6 AS gap,
        (f.tokens_seen - coalesce(lag(f.tokens_seen) OVER w, s.start_tokens)) // 2 AS tokens_since_last
      FROM fold f JOIN starts s USING (run) WHERE f.logged WINDOW w AS (PARTITION BY f.run ORDER BY f.rn)),
    e AS (SELECT *, (t - start_t) / 1e6 / greatest(1, step - start_step) * (max_steps - done) AS seconds_left,
          done / max_steps * 100 AS pct_done FROM p, total)
    SELECT run, step, round(pct_done, 6) AS pct_done, tokens_since_last,
      round(CASE WHEN gap = 0 THEN NULL ELSE tokens_since_last / gap END, 6) AS throughput, round(seconds_left, 3) AS seconds_left,
      format('{{}}:{{:02d}}:{{:02d}}', CAST(floor(seconds_left) AS BIGINT) // 3600, CAST(floor(seconds_left) AS BIGINT) % 3600 // 60,
             CAST(floor(seconds_left) AS BIGINT) % 60) AS remaining FROM e""",
    casts="tokens_since_last BIGINT",
)
def progress_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.progress_rows(spark, sf)
    log = m.progress_log(rows, INTERVAL, v.table(spark, sf, "events").count(), sequence_parallel=2)
    return log.withColumns(
        {"pct_done": r6("pct_done"), "throughput": r6("throughput"), "seconds_left": F.round("seconds_left", 3)}
    )


@query(
    "format_duration",
    """SELECT event_id, format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS duration
    FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events)""",
)
def format_duration(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select("event_id", text.format_duration(F.col("value") * 100).alias("duration"))


@query(
    "valid_values",
    f"WITH {v.EVAL_ROWS_SQL} SELECT dataset, idx, metric, round(value, 6) AS value FROM eval_rows WHERE NOT isnan(value)",
)
def valid_values(spark: SparkSession, sf: str) -> DataFrame:
    return m.valid_values(v.eval_rows(spark, sf)).withColumn("value", r6("value"))


def _eval_sql(prefix: str, keys: str) -> str:
    group = "GROUP BY " + (f"{keys}, metric" if keys else "metric")
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}{prefix} || '_' || metric AS name, round(avg(value) FILTER (NOT isnan(value)), 6) AS value FROM eval_rows {group}
    UNION ALL SELECT {lead}{prefix} || '_' || metric || '___samples', CAST(count(*) FILTER (NOT isnan(value)) AS DOUBLE) FROM eval_rows {group}"""


@query(
    "eval_means",
    f"""WITH {v.EVAL_ROWS_SQL} {_eval_sql("'eval'", '')}
    UNION ALL SELECT 'eval_loss', round(avg(value / 2), 6) FROM events
    UNION ALL SELECT 'eval_samples', CAST(count(*) AS DOUBLE) FROM events""",
)
def eval_means(spark: SparkSession, sf: str) -> DataFrame:
    losses = v.table(spark, sf, "events").select((F.col("value") / 2).alias("loss"))
    return m.eval_summary(v.eval_rows(spark, sf), losses).withColumn("value", r6("value"))


@query("eval_by_dataset", f"""WITH {v.EVAL_ROWS_SQL} {_eval_sql("'eval_' || dataset", 'dataset')}""")
def eval_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.eval_rows(spark, sf)
    return m.eval_means(rows, "dataset", prefix=F.concat(F.lit("eval_"), F.col("dataset"))).withColumn("value", r6("value"))


@query(
    "union_eval",
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS eval_idx FROM documents""",
)
def union_eval(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id")
    sampled = ordering.replica_shards_eval(docs, "doc_id", world=3)
    parts = [sampled.filter(F.col("replica") == r).select("doc_id", "eval_idx") for r in range(3)]
    return m.union_eval(parts, docs.count())


@query(
    "prefix_metric_names",
    """SELECT event_id, CASE WHEN starts_with(n, 'eval_') THEN n ELSE 'eval_' || n END AS name FROM (
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'eval_' || event_type ELSE event_type END AS n FROM events)""",
)
def prefix_metric_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("eval_"), "event_type")).otherwise(F.col("event_type"))
    maps = v.table(spark, sf, "events").select("event_id", F.create_map(name, "value").alias("metrics"))
    return maps.select("event_id", F.explode(F.map_keys(text.prefix_metric_map(F.col("metrics")))).alias("name"))


@query(
    "task_report",
    f"""WITH {v.GAPS_SQL}, {v.PENALTIES_SQL}
    SELECT CASE g.task_id WHEN 0 THEN 'Single QA' WHEN 1 THEN 'MultiHop QA' WHEN 2 THEN 'Summarization' WHEN 3 THEN 'Code'
      WHEN 4 THEN 'In-Context Learning' ELSE 'Unknown' END AS task, round(avg(actual), 6) AS actual, round(avg(target), 6) AS target,
      round(avg(abs(actual - target)), 6) AS loss FROM gaps g GROUP BY 1""",
)
def task_report(spark: SparkSession, sf: str) -> DataFrame:
    gaps = v.gaps(spark, sf).select(
        text.task_class_name(F.col("task_id")).alias("task"),
        F.inline(
            F.array(
                F.struct(F.lit("actual").alias("metric"), F.col("actual").alias("value")),
                F.struct(F.lit("target").alias("metric"), F.col("target").alias("value")),
                F.struct(F.lit("loss").alias("metric"), F.abs(F.col("actual") - F.col("target")).alias("value")),
            )
        ),
    )
    names = ("actual", "target", "loss")
    return m.task_report(gaps, names).select("task", *[r6(c).alias(c) for c in names])


@query(
    "throughput_report",
    """SELECT CASE WHEN event_id % 2 = 0 THEN 'prefill' ELSE 'decode' END AS phase, sum(1000 + user_id % 50) AS tokens,
    round(sum((1000 + user_id % 50)) / sum(value / 1000), 4) AS rate FROM events GROUP BY 1
    UNION ALL SELECT 'all', sum(1000 + user_id % 50), round(sum((1000 + user_id % 50)) / sum(value / 1000), 4) FROM events""",
    casts="tokens BIGINT",
)
def throughput_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events").select(
        F.when(F.pmod("event_id", F.lit(2)) == 0, "prefill").otherwise("decode").alias("phase"),
        (1000 + F.pmod("user_id", F.lit(50))).alias("tokens"),
        (F.col("value") / 1000).alias("seconds"),
    )
    return m.throughput_report(rows).select("phase", "tokens", F.round("rate", 4).alias("rate"))


@query(
    "metrics_json_sink",
    f"""WITH {v.METRIC_ROWS_SQL} SELECT CAST(step AS BIGINT) AS step, 'Spa-' || task AS metric, round(avg(value), 6) AS value
    FROM metric_rows GROUP BY 1, 2""",
)
def metrics_json_sink(spark: SparkSession, sf: str) -> DataFrame:
    means = m.task_means(v.metric_rows(spark, sf), ("value",), "step", "task")
    path = stage_path(spark, "metrics-json")
    pack_cache.metrics_json_sink(means.select("step", F.concat(F.lit("Spa-"), "task").alias("metric"), "value"), path)
    read = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("j"))
    return read.select(F.col("j")["step"].cast("bigint").alias("step"), F.explode("j").alias("metric", "value")).filter(
        F.col("metric") != "step"
    ).withColumn("value", r6("value"))


MAX_STEPS = 600  # of the schedules; hours of the event stream beyond it stay at the end values

CONFIG_ROWS = [  # fixed values: start and end share of each task
    ("default", 0.1, 0.7),
    ("Code", 0.0, 1.0),
    ("In-Context Learning", 0.0, 1.0),
    ("MultiHop QA", 0.0, 0.7),
    ("Single QA", 0.0, 0.7),
    ("Summarization", 0.0, 1.0),
]
CONFIG_SQL = "cfg(task, s, e) AS (VALUES " + ", ".join(f"('{t}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for t, a, b in CONFIG_ROWS) + ")"
STEP_TASKS_SQL = f"""{v.METRIC_ROWS_SQL}, {CONFIG_SQL}, st AS (SELECT event_id, step, CASE event_id % 6 WHEN 0 THEN 'Single QA' WHEN 1 THEN 'MultiHop QA'
  WHEN 2 THEN 'Summarization' WHEN 3 THEN 'Code' WHEN 4 THEN 'In-Context Learning' ELSE 'Other' END AS task FROM metric_rows),
  looked AS (SELECT st.event_id, st.step, st.task, coalesce(c.s, d.s) AS s, coalesce(c.e, d.e) AS e
    FROM st LEFT JOIN cfg c USING (task), (SELECT * FROM cfg WHERE task = 'default') d)"""


def _step_tasks(spark: SparkSession, sf: str) -> DataFrame:
    config = {task: (start, end) for task, start, end in CONFIG_ROWS}
    rows = v.metric_rows(spark, sf).select("event_id", "step", v._task_of(F.pmod("event_id", F.lit(6))).alias("task"))
    return m.task_config_lookup(rows, config)


@query("task_config_lookup", f"WITH {STEP_TASKS_SQL} SELECT event_id, task, s AS start, e AS \"end\" FROM looked")
def task_config_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _step_tasks(spark, sf).select("event_id", "task", "start", "end")


WARMUP = schedules.warmup_steps(0.8, MAX_STEPS)


@query(
    "target_schedule",
    f"""WITH {STEP_TASKS_SQL} SELECT event_id, task, round(CASE WHEN step < {WARMUP} THEN s + (e - s) * (step / {float(WARMUP)}) ELSE e END, 6)
    AS target FROM looked""",
)
def target_schedule(spark: SparkSession, sf: str) -> DataFrame:
    target = schedules.target_schedule(F.col("step"), F.col("start"), F.col("end"), WARMUP)
    return _step_tasks(spark, sf).select("event_id", "task", r6(target).alias("target"))


@query(
    "tau_schedule",
    f"""WITH {v.METRIC_ROWS_SQL} SELECT DISTINCT step, round(CASE WHEN step < 360 THEN 1 + 0.25 * (1 + cos(pi() * step / 360.0)) ELSE 1 END, 6)
    AS tau FROM metric_rows""",
)
def tau_schedule(spark: SparkSession, sf: str) -> DataFrame:
    steps = v.metric_rows(spark, sf).select("step").distinct()
    return steps.select("step", r6(schedules.tau_schedule(F.col("step"), MAX_STEPS)).alias("tau"))


@query(
    "lr_floor",
    f"""WITH {v.METRIC_ROWS_SQL} SELECT event_id, step, round(CASE WHEN step < 60 THEN value / 100 ELSE 0.1 + value / 100 * 0.9 END, 6) AS factor
    FROM metric_rows""",
)
def lr_floor(spark: SparkSession, sf: str) -> DataFrame:
    factor = schedules.lr_floor(F.col("step"), F.col("value") / 100, 0.1, 60)
    return v.metric_rows(spark, sf).select("event_id", "step", r6(factor).alias("factor"))


@query(
    "stripe_values",
    f"""WITH {v.MASK_VALUES_SQL} SELECT layer, head, CASE WHEN layer % 5 < 2 THEN 10.0 ELSE -10.0 END AS keep_first,
    CASE WHEN layer % 5 < 2 THEN -10.0 ELSE 10.0 END AS drop_first FROM mask_values""",
    casts="keep_first DOUBLE, drop_first DOUBLE",
)
def stripe_values(spark: SparkSession, sf: str) -> DataFrame:
    return v.mask_values(spark, sf).select(
        "layer", "head", schedules.stripe_value(F.col("layer"), 2, 3).alias("keep_first"),
        schedules.stripe_value(F.col("layer"), 2, 3, start_with_keep=False).alias("drop_first"),
    )


@query(
    "lambda_lookup",
    f"""WITH {v.GAPS_SQL}, {v.PENALTIES_SQL} SELECT sample_id, g.task_id, lambda1, lambda2 FROM gaps g LEFT JOIN penalties p ON p.task_id = g.task_id""",
)
def lambda_lookup(spark: SparkSession, sf: str) -> DataFrame:
    looked = m.lambda_lookup(v.gaps(spark, sf), v.penalties(spark))
    return looked.select("sample_id", "task_id", "lambda1", "lambda2")


@query(
    "macro_task_loss",
    f"""WITH {v.GAPS_SQL}, {v.PENALTIES_SQL}, t AS (
      SELECT CASE g.task_id WHEN 0 THEN 'Single QA' WHEN 1 THEN 'MultiHop QA' WHEN 2 THEN 'Summarization' WHEN 3 THEN 'Code'
        WHEN 4 THEN 'In-Context Learning' ELSE 'Unknown' END AS task,
        avg(lambda1 * abs(actual - target) + lambda2 * (actual - target) ** 2) AS loss, count(*) AS samples
      FROM gaps g LEFT JOIN penalties p ON p.task_id = g.task_id GROUP BY 1)
    SELECT task, round(loss, 6) AS loss, samples FROM t UNION ALL SELECT 'macro', round(avg(loss), 6), sum(samples) FROM t""",
    casts="samples BIGINT",
)
def macro_task_loss(spark: SparkSession, sf: str) -> DataFrame:
    return m.macro_task_loss(v.gaps(spark, sf), v.penalties(spark)).withColumn("loss", r6("loss"))


@query("abs_gap_loss", f"WITH {v.GAPS_SQL} SELECT round(avg(abs(actual - target)), 6) AS loss, count(*) AS samples FROM gaps")
def abs_gap_loss(spark: SparkSession, sf: str) -> DataFrame:
    return m.abs_gap_loss(v.gaps(spark, sf)).withColumn("loss", r6("loss"))


@query(
    "kept_ratio",
    f"""WITH {v.MASK_VALUES_SQL} SELECT layer, round(1 - sum(CASE WHEN value > 0.5 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS dropped_share
    FROM mask_values GROUP BY ROLLUP (layer)""",
)
def kept_ratio(spark: SparkSession, sf: str) -> DataFrame:
    masks = v.mask_values(spark, sf).withColumn("kept", F.col("value") > 0.5)
    return m.kept_ratio(masks).withColumn("dropped_share", r6("dropped_share"))


@query(
    "block_weighted_loss",
    """SELECT l_orderkey AS pack, round(sum(l_quantity * round(l_tax * 100)) / greatest(sum(l_quantity), 1), 6) AS loss,
    sum(round(l_tax * 100)) AS token_scaled FROM lineitem GROUP BY 1""",
)
def block_weighted_loss(spark: SparkSession, sf: str) -> DataFrame:
    blocks = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pack"), F.col("l_quantity").alias("valid"), F.round(F.col("l_tax") * 100).alias("loss")
    )
    mean = m.block_weighted_loss(blocks, "pack").select("pack", r6("loss").alias("loss"))
    scaled = m.block_weighted_loss(blocks, "pack", token_scaled=True).select("pack", r6("loss").alias("token_scaled"))
    return mean.join(scaled, "pack")


@query(
    "no_label_guard",
    """SELECT l_orderkey AS pack, CASE WHEN sum(n) = 0 THEN 0.0 ELSE round(sum(n * tax) / sum(n), 6) END AS loss
    FROM (SELECT l_orderkey, round(l_tax * 100) AS tax, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS n FROM lineitem) GROUP BY 1""",
)
def no_label_guard(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0)
    sums = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pack")).agg(
        F.sum(n * F.round(F.col("l_tax") * 100)).alias("total"), F.sum(n).alias("valid")
    )
    loss = schedules.or_zero_without_labels(F.try_divide("total", "valid"), F.col("valid"))
    return sums.select("pack", r6(loss).alias("loss"))
