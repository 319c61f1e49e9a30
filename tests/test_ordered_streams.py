"""Streams over files in any order equal the batch result."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from sparkloom.operators import metrics, packing
from sparkloom.streaming import ordered

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def files_in_any_order(spark, rows, schema, folder, files, seed=1):
    """Rows dealt to files at random: a stream with one file per batch."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


LOGS = "run string, ts timestamp, step long, t long, force boolean"


def log_rows(n=200):
    seconds = [10 * i + (i * 7) % 5 for i in range(n)]
    return [(("a", "a", "b")[i % 3], at(s), i, s * 1_000_000, i % 97 == 0) for i, s in enumerate(seconds)]


def test_rate_limit_of_files_in_any_order(spark, tmp_path):
    stream = files_in_any_order(spark, log_rows(), LOGS, str(tmp_path / "in"), 5)
    got = ordered.drain_in_order(stream, lambda s: ordered.ordered_rate_limit(s, 55_000_000, late="1 day"), "logged").collect()
    batch = spark.createDataFrame(log_rows(), LOGS).drop("ts")
    want = metrics.rate_limited_log(batch, 55_000_000).collect()
    assert sorted((r.run, r.step, r.t, r.log_no) for r in got) == sorted((r.run, r.step, r.t, r.log_no) for r in want)


def test_rows_come_out_before_the_end(spark, tmp_path):
    """What the watermark has passed is written by the first run; late rows are dropped."""
    rows = log_rows(60)
    folder = str(tmp_path / "in")
    for part in (rows[:40], rows[40:], [("a", at(0), 999, 0, True)]):
        spark.createDataFrame(part, LOGS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(folder)
    both, markers = ordered.with_markers(stream)
    out = ordered.ordered_rate_limit(both, 55_000_000, late="1 minute")
    with ordered.state_store(spark):
        path = ordered.drain_to_path(out, "logged")
        early = spark.read.schema(out.schema).parquet(path).collect()
        ordered.write_marker(spark, markers, stream.schema)
        ordered.drain_to_path(out, "logged", path)
    every = spark.read.schema(out.schema).parquet(path).collect()
    want = metrics.rate_limited_log(spark.createDataFrame(rows, LOGS).drop("ts"), 55_000_000).collect()
    assert sorted((r.run, r.step, r.log_no) for r in every) == sorted((r.run, r.step, r.log_no) for r in want)
    assert 0 < len(early) < len(every)


def test_a_run_that_is_forgotten_starts_anew(spark, tmp_path):
    rows = [("a", at(s), s, s * 1_000_000, False) for s in (0, 100, 200)] + [("a", at(9000), 9000, 9_000_000_000, True)]
    folder = str(tmp_path / "in")
    for part in (rows[:3], [("b", at(8000), 8000, 8_000_000_000, True)], rows[3:]):
        spark.createDataFrame(part, LOGS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(folder)
    for forget, number in ((None, 2), (600.0, 0)):
        out = ordered.drain_in_order(stream, lambda s: ordered.ordered_rate_limit(s, 55_000_000, late="1 second", forget=forget), "logged")
        assert {r.step: r.log_no for r in out.collect() if r.run == "a"}[9000] == number


KNOWN = "run string, ts timestamp, step long, task string, value double"


def test_last_known_over_steps_that_occur(spark, tmp_path):
    rng = random.Random(3)
    steps = sorted(rng.sample(range(10**9), 30))
    rows = [("r", at(k), s, t, float(s % 97)) for k, s in enumerate(steps) for t in "abc" if rng.random() < 0.5]
    stream = files_in_any_order(spark, rows, KNOWN, str(tmp_path / "in"), 4)
    got = ordered.drain_in_order(stream, lambda s: ordered.ordered_last_known(s, late="1 day"), "known").collect()
    batch = spark.createDataFrame(rows, KNOWN).select("step", "task", "value")
    want = metrics.last_known_fill(batch).collect()
    assert sorted((r.step, r.task, r.value, r.carried) for r in got) == sorted((r.step, r.task, r.value, r.carried) for r in want)
    assert max(r.step for r in got if r.task == "a") == max(s for _, _, s, _, _ in rows)  # past its own last value


def test_tasks_are_forgotten(spark, tmp_path):
    rows = [("r", at(0), 0, "old", 1.0), ("r", at(10), 1, "new", 2.0), ("r", at(1000), 2, "new", 3.0)]
    stream = files_in_any_order(spark, rows, KNOWN, str(tmp_path / "in"), 2)
    got = ordered.drain_in_order(stream, lambda s: ordered.ordered_last_known(s, late="1 day", forget=100.0), "known").collect()
    assert sorted((r.step, r.task, r.carried) for r in got) == [(0, "old", False), (1, "new", False), (1, "old", True), (2, "new", False)]


SAMPLES = "shard int, ts timestamp, idx long, n int, input_ids array<int>, user_len int, task_id int, task_type string"


def samples(count, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        n = rng.randint(1, 50)
        out.append((rng.choice([0, 0, 1]), at(i), i, n, [rng.randint(0, 99) for _ in range(n)], rng.randint(0, n), i % 4, f"task {i % 4}"))
    return out


@pytest.mark.parametrize("is_sft", [False, True])
def test_packs_equal_the_batch_operator(spark, tmp_path, is_sft):
    rows = samples(150)
    stream = files_in_any_order(spark, rows, SAMPLES, str(tmp_path / "in"), 4)
    packs = ordered.drain_in_order(stream, lambda s: ordered.ordered_packs(s, 120, late="1 day"), "packs")
    got = ordered.pack_rows(packs, is_sft=is_sft)
    frame = spark.createDataFrame(rows, SAMPLES)
    places = packing.pack_next_fit(frame.select("shard", "idx", "n"), 120).select("shard", "idx", "pack_no")
    want = packing.finalize_pack(frame.join(places, ["shard", "idx"]), "shard", "pack_no", is_sft=is_sft)
    assert got.columns == want.columns
    assert sorted(map(repr, (r.asDict() for r in got.collect()))) == sorted(map(repr, (r.asDict() for r in want.collect())))


def test_idle_packs_come_out_and_are_closed(spark, tmp_path):
    rows = [(0, at(s), i, 10, [1] * 10, 1, 0, "t") for i, s in enumerate((0, 1, 5000, 5001))]
    folder = str(tmp_path / "in")
    ticks = [(9, at(s), 100 + s, 10, [1] * 10, 1, 0, "t") for s in (4000, 9000)]
    for part in (rows[:2], ticks[:1], rows[2:], ticks[1:]):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder)
    for idle, want in ((None, [(0, [0, 1, 2, 3])]), (60.0, [(0, [0, 1]), (1, [2, 3])])):
        packs = ordered.drain_in_order(stream, lambda s: ordered.ordered_packs(s, 120, late="1 second", idle=idle), "packs")
        assert sorted((r.pack_no, [x.idx for x in r["items"]]) for r in packs.collect() if r.shard == 0) == want


def test_nulls_in_samples(spark, tmp_path):
    rows = [(0, at(i), i, 3, [1, 2, 3], 1, None, None) for i in range(3)]
    stream = files_in_any_order(spark, rows, SAMPLES, str(tmp_path / "in"), 1)
    packs = ordered.pack_rows(ordered.drain_in_order(stream, lambda s: ordered.ordered_packs(s, 6, late="1 day"), "packs"))
    assert sorted((r.pack_no, r.task_ids, r.task_type) for r in packs.collect()) == [(0, [None] * 2, [None] * 2), (1, [None], [None])]


def test_setting_is_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(ValueError), ordered.state_store(spark):
        raise ValueError
    assert spark.conf.get(key, None) == before


class _State(dict):
    """A state of a processor, in memory."""

    def getValue(self, key):
        return super().get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))

    def exists(self):
        return None in self

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _State())

    getValueState = getListState = getMapState

    def registerTimer(self, _):
        pass


class _Watermark:
    def __init__(self, milliseconds):
        self.milliseconds = milliseconds

    def getCurrentWatermarkInMs(self):
        return self.milliseconds


def test_rows_of_a_group_are_released_in_bounded_spans():
    """However many rows are due at once, the operator gets a few at a time, in order, and rows of one time together."""
    spans = []

    class Seen(ordered.InOrder):
        BLOCK_ROWS, SPAN_ROWS = 16, 64

        def advance(self, key, rows):
            spans.append(rows)
            yield rows

    kinds = {"step": T.LongType(), "tokens": T.ArrayType(T.IntegerType()), "value": T.DoubleType(), "event_us": T.LongType()}
    columns = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    processor, handle = Seen(columns, ["step"]), _Handle()
    processor.init(handle)
    steps = list(range(5000))
    random.Random(3).shuffle(steps)
    for first in range(0, 5000, 500):
        batch = [(s, np.arange(s % 5, dtype=np.int32), None if s % 7 == 0 else s / 2, s // 3 * 1_000_000) for s in steps[first : first + 500]]
        rows = pd.DataFrame(batch, columns=columns.names)
        assert not list(processor.handleInputRows(("g",), iter([rows]), _Watermark(-1)))
    list(processor.handleExpiredTimer(("g",), _Watermark(1_000_000), None))
    early = sum(map(len, spans))
    assert early == sum(s // 3 <= 1000 for s in steps) and all(v[0] > 1_000_000_000 for v in handle.states["index"].values())
    list(processor.handleExpiredTimer(("g",), _Watermark(10_000_000), None))
    assert not handle.states["waiting"] and not handle.states["index"]
    whole = pd.concat(spans)
    assert whole["step"].tolist() == list(range(5000))
    assert [len(t) for t in whole["tokens"]] == [s % 5 for s in range(5000)]
    assert whole["value"].isna().tolist() == [s % 7 == 0 for s in range(5000)]
    assert len(spans) > 10 and max(map(len, spans)) <= 64 + 16 * 10 * 2
    ends = [(a["event_us"].iloc[-1], b["event_us"].iloc[0]) for a, b in zip(spans, spans[1:])]
    assert all(x < y for x, y in ends)
