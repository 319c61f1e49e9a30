import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import lookups, metrics, selection


def grid_threshold(values, target):
    """The middle of the last cell of width 2**-27 in [0, 1] up to whose lower end the share of values is within the target."""
    cells = 1 << 27
    beyond = [v for k, v in enumerate(sorted(values), start=1) if k / len(values) > target]
    end = min(cells, max(1, math.ceil(beyond[0] * cells))) if beyond else cells
    return (end - 0.5) / cells


@pytest.mark.parametrize("target", [0.0, 0.25, 0.5, 0.7, 0.999, 1.0])
@pytest.mark.parametrize("kind", ["spread", "hot", "edges"])
def test_threshold(spark, target, kind):
    rng = random.Random(len(kind))
    values = {
        "spread": [rng.random() for _ in range(400)],
        "hot": [0.5 if i % 3 == 0 else rng.random() for i in range(400)],
        "edges": [0.0, 0.0, 1.0, 1.0, 0.25, 0.5, 2**-27, 1 - 2**-28],
    }[kind]
    frame = spark.createDataFrame([(v,) for v in values], "value double")
    assert selection.threshold_for_share(frame, target).first()[0] == pytest.approx(grid_threshold(values, target), abs=1e-12)


def plain_top(rows, target, seed=42):
    """Heads of the largest values, ties by the hash of the seed and the head."""
    def place(row):
        head, value = row
        size = -math.inf if value is None else (math.inf if value != value else value)
        return (value is None, -(value != value) if value is not None else 0, -size, hashlib.md5(f"{seed}:{head}".encode()).hexdigest())

    return {head for head, _ in sorted(rows, key=place)[: int(len(rows) * (1 - target))]}


@pytest.mark.parametrize("target", [0.0, 0.1, 0.33, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("kind", ["any range", "ties", "nulls"])
def test_selection_by_counting(spark, target, kind):
    rng = random.Random(7)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(150)] + [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324]
    if kind == "ties":
        values = [rng.choice([0.5, 0.5, 0.5, -0.0, 0.0, 2.0]) for _ in range(200)]
    if kind == "nulls":
        values = [rng.choice([None, 1.0, math.nan, -3.0]) for _ in range(200)]
    rows = list(enumerate(values))
    frame = spark.createDataFrame(rows, "head long, value double").repartition(5)
    got = selection.round_top_share(frame, ["head"], target)
    assert got.columns == ["head", "value", "rounded"]
    found = got.collect()
    assert len(found) == len(rows)
    assert {r["head"] for r in found if r.rounded == 10.0} == plain_top(rows, target)


def test_selection_moves_no_rows(spark):
    frame = spark.createDataFrame([(k, float(k % 7)) for k in range(100)], "head long, value double")
    plan = selection.round_top_share(frame, ["head"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert selection.round_top_share(frame.filter("false"), ["head"], 0.5).collect() == []


@pytest.mark.parametrize("k", [1, 2, 50, 99, 100])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.randint(-(1 << 63), (1 << 63) - 1) >> rng.randint(0, 60) for _ in range(100)]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    want = sorted(values, reverse=True)[k - 1]
    assert selection.kth_largest(frame, "v", k) == (want, sum(v > want for v in values))


def test_round_top_share(spark):
    rows = [(i, 0.5 if i % 3 else i / 300) for i in range(300)]
    frame = spark.createDataFrame(rows, "head int, value double")
    got = selection.round_top_share(frame, ["head"], 0.4).toPandas()
    high = got[got.rounded == 10.0]
    assert len(high) == int(300 * (1 - 0.4))
    assert high.value.min() >= got[got.rounded == -10.0].value.max()


def kept_blocks(scores, q, share, first_chunk):
    """Blocks kept for one query block, from the definition of the rule.

    The own block and block 0 are kept. Another one is kept while the mass that counts before it is short of the
    share: the forced blocks and all with higher scores. In the first chunk only the own block is forced, and the block
    just before the tested one does not count; for the best block nothing counts.
    """
    forced = {q} if first_chunk else {0, q}
    others = sorted(set(range(len(scores))) - forced, key=lambda k: (-scores[k], k))
    keep = forced | {0}
    for place, k in enumerate(others):
        counted = others[: place - 1 if first_chunk and place else place]
        before = sum(scores[j] for j in forced) + sum(scores[j] for j in counted)
        if first_chunk and place == 0:
            before = 0.0
        if round(before, 9) < round(sum(scores) * share, 9):
            keep.add(k)
    return {k for k in keep if k <= q}


@pytest.mark.parametrize("seed", range(4))
def test_top_p_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    chunk, cols = 4, 12
    rows, want = [], {}
    full = np.zeros((cols, cols))
    for q in range(cols):
        full[q, : q + 1] = rng.random(q + 1) ** 3
    for q in range(cols):
        kept = kept_blocks(full[q].tolist(), q, 0.7, q < chunk)
        want.update({(q, k): k in kept for k in range(cols)})
    for q in range(cols):
        for k in range(q + 1):
            rows.append((1, q, k, float(full[q, k])))
    frame = spark.createDataFrame(rows, "seq_id long, qb int, kb int, score double")
    literal = {(r.qb, r.kb): r.keep for r in selection.top_p_blocks(frame, 0.7, first_chunk=chunk).collect()}
    clean = {(r.qb, r.kb): r.keep for r in selection.top_p_blocks(frame, 0.7).collect()}
    for (q, k), keep in clean.items():
        if q >= chunk:
            assert keep == literal[(q, k)] == want[(q, k)]
        else:
            assert literal[(q, k)] == want[(q, k)]
            assert literal[(q, k)] or not keep  # the clean rule keeps a subset there
        if k in (0, q):
            assert keep
    for q in range(cols):
        kept = sum(full[q, k] for k in range(q + 1) if clean[(q, k)])
        assert kept >= 0.7 * full[q].sum() - 1e-9


def test_softmax_of_far_values(spark):
    rows = [(0, 900.0), (0, 903.0), (0, -5000.0), (1, -800.0), (1, -800.0), (2, 7.0)] + [(3, float(i)) for i in range(200)]
    got = selection.scale_softmax(spark.createDataFrame(rows, "g int, x double"), "g", "x", 2.0).collect()
    for g in range(4):
        values = [x for k, x in rows if k == g]
        top = max(values)
        total = sum(math.exp((x - top) / 2) for x in values)
        for r in (r for r in got if r.g == g):
            assert r.share == pytest.approx(math.exp((r.x - top) / 2) / total, abs=1e-12)


def test_weighted_pick_follows_the_shares(spark):
    groups = 4000
    frame = (
        spark.range(groups * 3)
        .select(F.floor(F.col("id") / 3).alias("g"), (F.col("id") % 3).cast("int").alias("item"))
        .withColumn("x", F.element_at(F.array(F.lit(0.0), F.lit(math.log(3.0)), F.lit(math.log(6.0))), F.col("item") + 1))
        .withColumn("u", (F.pmod(F.xxhash64("g", "item"), F.lit(1 << 30)) + 0.5) / float(1 << 30))
    )
    got = selection.weighted_pick(frame, "g", "item", "x", "u", 1.0).groupBy("item").count().collect()
    share = {r["item"]: r["count"] / groups for r in got}
    for item, want in enumerate((0.1, 0.3, 0.6)):
        assert share[item] == pytest.approx(want, abs=0.03)


def test_lookups_agree(spark):
    rows = [(7 if i % 3 == 0 else i, i) for i in range(400)] + [(None, -1)]
    big = spark.createDataFrame(rows, "k long, i long")
    table = spark.createDataFrame([(i, i * 2) for i in range(0, 300, 2)] + [(7, 1)], "k long, v long")
    want = sorted(big.join(table, "k", "left").select("k", "i", "v").collect(), key=str)
    for got in (lookups.lookup_join(big, table, "k", 16), lookups.split_join(big, table, "k", hot_keys=3), lookups.lookup_join(big, table, "k", 64 << 20)):
        assert sorted(got.select("k", "i", "v").collect(), key=str) == want


def test_merged_means_are_means_of_all_rows(spark):
    frame = spark.createDataFrame([(i % 5, "ab"[i % 2], None if i % 7 == 0 else float(i)) for i in range(100)], "rank int, metric string, value double")
    whole = {r.metric: r["mean"] for r in metrics.scalar_means(frame).collect()}
    merged = {r.metric: r["mean"] for r in metrics.rank_merge(metrics.rank_partials(frame, "metric", "rank"), "metric").collect()}
    assert whole == pytest.approx(merged)
    assert metrics.scalar_means(frame.withColumn("value", F.lit(None).cast("double"))).count() == 0


def test_eval_of_nothing_valid(spark):
    frame = spark.createDataFrame([("m", float("nan")), ("m", float("nan")), ("eval_n", 2.0)], "metric string, value double")
    got = {r.name: r.value for r in metrics.eval_means(frame).collect()}
    assert math.isnan(got["eval_m"]) and got["eval_m___samples"] == 0
    assert got["eval_n"] == 2.0 and got["eval_n___samples"] == 1


def test_unknown_class_is_left_out_of_the_macro_mean(spark):
    samples = spark.createDataFrame([(0, 1.0, 0.5), (0, 0.5, 0.5), (1, 0.0, 1.0), (5, 1.0, 0.0)], "task_id int, actual double, target double")
    penalties = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 2.0)], "task_id int, lambda1 double, lambda2 double")
    got = {r.task: r.loss for r in metrics.macro_task_loss(samples, penalties).collect()}
    assert got == {"Single QA": 0.25, "MultiHop QA": 2.0, "Unknown": None, "macro": pytest.approx((0.25 + 2.0) / 2)}


def test_last_known_over_chunks(spark):
    rows = [(s, t, float(s)) for s in range(0, 60) for t in ("a", "b") if (t == "a" and s % 7 == 0) or (t == "b" and s >= 10 and s % 3 == 0)]
    frame = spark.createDataFrame(rows, "step long, task string, value double")
    got = metrics.last_known_fill(frame, chunks=6).toPandas()
    steps = sorted({r[0] for r in rows})
    for task in ("a", "b"):
        own = {s: v for s, t, v in rows if t == task}
        part = got[got.task == task].sort_values("step")
        assert part.step.tolist() == [s for s in steps if s >= min(own)]
        known = None
        for s, value, carried in zip(part.step, part.value, part.carried):
            known = own.get(s, known)
            assert value == known and carried == (s not in own)


def test_callers_metrics(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "dataset string, value double")
    got = metrics.compute_metrics(frame, [F.max("value").alias("top"), F.count("*").alias("n")], "dataset").collect()
    assert {r.dataset: (r.top, r.n) for r in got} == {"a": (3.0, 2), "b": (5.0, 1)}


def test_metric_names_are_fixed(spark):
    schema = "batch int, metrics map<string,double>"
    good = spark.createDataFrame([(0, {"x": 1.0, "y": 2.0}), (1, {"y": 4.0, "x": 3.0})], schema)
    rows = metrics.metric_map_rows(good, ["x", "y"]).collect()
    assert sorted((r.batch, r.metric, r.value) for r in rows) == [(0, "x", 1.0), (0, "y", 2.0), (1, "x", 3.0), (1, "y", 4.0)]
    bad = spark.createDataFrame([(0, {"x": 1.0})], schema)
    with pytest.raises(Exception, match="metric names differ"):
        metrics.metric_map_rows(bad, ["x", "y"]).collect()


def test_softmax_keeps_the_null_group_and_many_steps(spark):
    rows = [(None, 1.0), (None, 1.0), (0, 5.0)] + [(1, float(i)) for i in range(1000)]
    got = selection.scale_softmax(spark.createDataFrame(rows, "g int, x double"), "g", "x", 1e-3).collect()
    assert len(got) == len(rows)
    assert sorted(r.share for r in got if r.g is None) == [0.5, 0.5]
    assert sorted(r.share for r in got if r.g == 1)[-2:] == [0.0, 1.0]


def test_threshold_of_values_beyond_the_grid(spark):
    frame = spark.createDataFrame([(float(10**k),) for k in range(-3, 30)] + [(float("inf"),)], "value double")
    assert selection.threshold_for_share(frame, 0.05).first()[0] == pytest.approx(0.01, abs=1e-6)


def test_lookup_with_nulls_doubled_keys_and_wide_rows(spark):
    big = spark.createDataFrame([(k,) for k in [None] * 50 + [1, 2, 3] * 20], "k int")
    table = spark.createDataFrame([(1, "x" * 120_000), (2, "b")], "k int, v string")
    for limit in (lookups.BROADCAST_BYTES, 1000):
        got = lookups.lookup_join(big, table, "k", limit).collect()
        assert len(got) == 110 and sum(r.v is not None for r in got) == 40
    with pytest.raises(ValueError):
        lookups.lookup_join(big, table.union(table), "k")
