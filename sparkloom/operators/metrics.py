"""Run metrics: merged means, carry-forward, running means, progress, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import text
from sparkloom.operators.greedy import Gap, greedy_cuts
from sparkloom.operators.ordering import running, with_global_index
from sparkloom.session import cut


def valid_values(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is a number."""
    return df.filter(~F.isnan(value))


def scalar_means(df: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """Mean per name; nulls neither add nor count, and a name without values is left out."""
    return df.groupBy(name).agg(F.avg(value).alias("mean")).filter(F.col("mean").isNotNull())


def task_means(df: DataFrame, measures: Sequence[str], *keys: str) -> DataFrame:
    """Mean of each measure per task (and further keys), with the number of samples."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures], F.count("*").alias("samples"))


def rank_partials(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Sums and counts as each rank would hold them."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def rank_merge(partials: DataFrame, *keys: str) -> DataFrame:
    """Add the sums and counts of all ranks, then divide: never a mean of means."""
    return (
        partials.groupBy(*keys)
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .filter(F.col("n") > 0)
        .select(*keys, (F.col("total") / F.col("n")).alias("mean"), "n")
    )


def last_known_fill(
    step_values: DataFrame, step: str = "step", task: str = "task", value: str = "value", chunks: int | None = None
) -> DataFrame:
    """Every step lists all tasks seen so far; one without data repeats its last value.

    ``step_values`` has one row per step and task, so it is small next to the data.
    The steps that occur are numbered, each task is spread over the numbers from its first step on, and
    numbers are turned back into steps; so step ids may lie as far apart as they like.
    """
    rows = cut(step_values.select(step, task, value))  # read several times
    steps = cut(with_global_index(rows.select(step).distinct(), step, name="_nth", total="_steps", chunks=chunks))
    firsts = rows.groupBy(task).agg(F.min(step).alias(step)).join(steps, step)
    spans = firsts.select(task, F.explode(F.sequence("_nth", F.col("_steps") - 1)).alias("_nth"))
    filled = spans.join(steps.drop("_steps"), "_nth").drop("_nth").join(rows, [task, step], "left")
    return running(filled, [task], [step], chunks=chunks, known=("last", value)).select(
        step, task, F.col("known").alias(value), F.col(value).isNull().alias("carried")
    )


def running_mean(
    step_values: DataFrame, step: str = "step", value: str = "value", key: str | None = None, chunks: int | None = None
) -> DataFrame:
    """Mean of the per-step values up to each step."""
    keys = [key] if key else []
    sums = running(step_values, keys, [step], chunks=chunks, _sum=("sum", value), _n=("count", value))
    return sums.withColumn("running_mean", F.col("_sum") / F.col("_n")).drop("_sum", "_n")


def rate_limited_log(
    rows: DataFrame, interval: int, max_steps: int | None = None, run: str = "run", chunks: int | None = None
) -> DataFrame:
    """Rows (run, step, t, force) that are logged: more than ``interval`` after the last
    logged row, forced, or among the last two steps. The clock starts at the first row.
    """
    force = F.col("force")
    if max_steps is not None:
        force = force | (F.col("step") >= max_steps - 1)
    cuts = greedy_cuts(rows.withColumn("force", force), run, ["t", "step"], Gap(interval), chunks=chunks)
    return cuts.filter("_starts").withColumnRenamed("_cut", "log_no").drop("_starts")


def progress_log(
    rows: DataFrame, interval: int, max_steps: int, sequence_parallel: int = 1, chunks: int | None = None
) -> DataFrame:
    """Share done, tokens and rate since the last logged row, and time left, per logged row.

    ``rows``: run, step, t (microseconds), tokens (of the row), force.
    """
    seen = running(
        rows, ["run"], ["t", "step"], chunks=chunks,
        tokens_seen=("sum", "tokens"), start_t=("first", "t"), start_step=("first", "step"), start_tokens=("first", "tokens"),
    ).drop("tokens")
    logged = rate_limited_log(seen, interval, max_steps, chunks=chunks)
    paired = running(
        logged, ["run"], ["t", "step"], chunks=chunks, last_t=("prev", "t"), last_tokens=("prev", "tokens_seen")
    )
    gap = (F.col("t") - F.coalesce("last_t", "start_t")) / 1e6
    tokens = F.floor((F.col("tokens_seen") - F.coalesce("last_tokens", "start_tokens")) / sequence_parallel)
    done = F.greatest("step", F.lit(1))
    elapsed = (F.col("t") - F.col("start_t")) / 1e6
    left = elapsed / F.greatest(F.lit(1), F.col("step") - F.col("start_step")) * (F.lit(max_steps) - done)
    return paired.select(
        "run",
        "step",
        (done / max_steps * 100).alias("pct_done"),
        tokens.alias("tokens_since_last"),
        F.try_divide(tokens.cast("double"), gap).alias("throughput"),
        left.alias("seconds_left"),
        text.format_duration(left).alias("remaining"),
    )


def eval_means(values: DataFrame, *keys: str, prefix: Column | str = "eval") -> DataFrame:
    """Long form (name, value): mean of the valid values and their number, per metric.

    ``values``: keys, idx, metric, value. The name of each metric gets the prefix once.
    """
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    valid = F.when(~F.isnan("value"), F.col("value"))
    means = values.groupBy(*keys, "metric").agg(
        F.coalesce(F.avg(valid), F.lit(float("nan"))).alias("mean"), F.count(valid).cast("double").alias("samples")
    )
    start = F.concat(head, F.lit("_"))
    named = F.when(F.startswith(F.col("metric"), start), F.col("metric")).otherwise(F.concat(start, "metric"))
    both = F.array(
        F.struct(named.alias("name"), F.col("mean").alias("value")),
        F.struct(F.concat(named, F.lit("___samples")).alias("name"), F.col("samples").alias("value")),
    )
    return means.select(*keys, F.inline(both))


def eval_summary(values: DataFrame, losses: DataFrame, prefix: str = "eval") -> DataFrame:
    """Evaluation means, the plain mean loss and the number of samples, as (name, value)."""
    loss = losses.agg(F.avg("loss").alias("loss"), F.count("*").cast("double").alias("n")).select(
        F.inline(
            F.array(
                F.struct(F.lit(f"{prefix}_loss").alias("name"), F.col("loss").alias("value")),
                F.struct(F.lit(f"{prefix}_samples").alias("name"), F.col("n").alias("value")),
            )
        )
    )
    return eval_means(values, prefix=prefix).unionByName(loss)


def compute_metrics(values: DataFrame, aggregates: Sequence[Column], *keys: str) -> DataFrame:
    """A caller's own metrics: named aggregate columns, or grouped Arrow UDFs, per key."""
    return values.groupBy(*keys).agg(*aggregates)


def metric_map_rows(batches: DataFrame, names: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """Long rows (metric, value) of a map column whose keys must be the same in every batch."""
    expected = F.array(*[F.lit(n) for n in sorted(names)])
    found = F.sort_array(F.map_keys(metrics))
    checked = F.when(found == expected, F.col(metrics)).otherwise(
        F.raise_error(F.concat(F.lit("metric names differ from the first batch: "), F.array_join(found, ","))).cast(
            batches.schema[metrics].dataType
        )
    )
    kept = [c for c in batches.columns if c != metrics]
    return batches.select(*kept, F.explode(checked).alias("metric", "value"))


def union_eval(parts: Sequence[DataFrame], samples: int, idx: str = "eval_idx") -> DataFrame:
    """Values of all replicas, without the rows that only padded the sampler."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col(idx) < samples)


def task_report(long: DataFrame, metrics: Sequence[str], task: str = "task") -> DataFrame:
    """One line per task, one column per metric, by name."""
    return long.groupBy(task).pivot("metric", list(metrics)).agg(F.avg("value")).orderBy(task)


def throughput_report(rows: DataFrame, phase: str = "phase", tokens: str = "tokens", seconds: str = "seconds") -> DataFrame:
    """Tokens per second of each phase apart, and of all."""
    return rows.rollup(phase).agg(
        F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"), (F.sum(tokens) / F.sum(seconds)).alias("rate")
    ).withColumn(phase, F.coalesce(phase, F.lit("all")))


def lambda_lookup(samples: DataFrame, penalties: DataFrame) -> DataFrame:
    """Penalties of each sample's class; a class without any keeps nulls.

    The penalty table has one row per class id, so its size is fixed.
    """
    return samples.join(F.broadcast(penalties), "task_id", "left")


def task_config_lookup(samples: DataFrame, config: dict[str, tuple[float, float]], task: str = "task") -> DataFrame:
    """Start and end of the sample's task, or those of ``default``.

    The configuration is a handful of task names, so it becomes a map literal and
    the lookup needs no join.
    """
    pairs = [(F.lit(name), F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"))) for name, (a, b) in config.items()]
    known = F.create_map(*[x for pair in pairs for x in pair])
    found = F.coalesce(
        F.try_element_at(known, F.coalesce(F.col(task), F.lit("default"))), F.try_element_at(known, F.lit("default"))
    )
    return samples.withColumns({"start": found["start"], "end": found["end"]})


def macro_task_loss(samples: DataFrame, penalties: DataFrame) -> DataFrame:
    """Weighted gap per sample, mean per class, mean over the classes present.

    Classes without penalties are reported as unknown and stay out of the macro mean.
    """
    from sparkloom.functions.schedules import gap_penalty

    loss = gap_penalty(F.col("actual"), F.col("target"), F.col("lambda1"), F.col("lambda2"))
    per_task = (
        lambda_lookup(samples, penalties)
        .groupBy(text.task_class_name(F.col("task_id")).alias("task"))
        .agg(F.avg(loss).alias("loss"), F.count("*").alias("samples"))
    )
    return per_task.rollup("task").agg(F.avg("loss").alias("loss"), F.sum("samples").alias("samples")).withColumn(
        "task", F.coalesce("task", F.lit("macro"))
    )


def abs_gap_loss(samples: DataFrame) -> DataFrame:
    return samples.agg(F.avg(F.abs(F.col("actual") - F.col("target"))).alias("loss"), F.count("*").alias("samples"))


def kept_ratio(masks: DataFrame, layer: str = "layer", kept: str = "kept") -> DataFrame:
    """1 - kept / all, per layer and (null layer) over all."""
    return masks.rollup(layer).agg((1 - F.sum(F.col(kept).cast("double")) / F.count("*")).alias("dropped_share"))


def block_weighted_loss(blocks: DataFrame, *keys: str, token_scaled: bool = False) -> DataFrame:
    """Block losses weighted by their valid labels, or their plain sum when token-scaled."""
    if token_scaled:
        loss = F.sum("loss")
    else:
        loss = F.sum(F.col("valid") * F.col("loss")) / F.greatest(F.sum("valid"), F.lit(1))
    return blocks.groupBy(*keys).agg(loss.alias("loss"), F.sum("valid").alias("valid"))
