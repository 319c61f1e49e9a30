"""Streams whose rows arrive in any order: state holds them until the watermark has passed.

Each operator here is a processor per group. Arriving rows wait in the state; an event-time timer, or the next rows of
the group, releases those that the watermark has passed, in order, and only they change the state of the operator. So the
result depends on the rows, not on the files or batches they came in. Rows behind the watermark are late and dropped,
as in every stream. What waits is bounded by the watermark's delay; what a group keeps besides, by its operator.

Rows wait in blocks of bounded size, each a sorted run of what came in together. They are released by a sweep over the
first times of the blocks, so that Python holds a block or so of each run, however many rows of a group are due at once.

``finish`` sends a marker that lets the watermark pass all rows, so that what is still open comes out.
Row times lie between 1970 and the year 2100, ends not included. The state lives in RocksDB, see :func:`state_store`.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.greedy import Budget, Gap, Open, cut_rows
from sparkloom.operators.packing import join_items
from sparkloom.session import stage_path
from sparkloom.streaming.jobs import drain_to_path

MARKER = datetime.datetime(2200, 1, 1)
_LAST_MS = 4_102_444_800_000  # the year 2100: a later watermark comes from a marker
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class state_store:
    """Within this context queries start with the state store that these operators need; the setting is restored."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_STORE, None)
        self.spark.conf.set(_STORE, _ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(_STORE)
        else:
            self.spark.conf.set(_STORE, self.before)


class InOrder(StatefulProcessor):
    """Rows with a column ``event_us`` (event time in microseconds), released in the order of ``order``.

    ``columns`` are the names and types that are kept while rows wait; ``order`` does not fall while times rise.
    """

    BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 18
    SPAN_ROWS, SPAN_BYTES = 1 << 16, 8 << 20

    def __init__(self, columns: T.StructType, order: list[str]) -> None:
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", "rows binary")
        self.index = handle.getMapState("index", "block long", "first long, last long")
        self.numbers = handle.getValueState("numbers", "next long")
        self.schema = to_arrow_schema(self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for batch in rows:
            if len(batch):
                self._keep(batch[self.columns.names])
                latest = max(latest or 0, int(batch["event_us"].max()))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        yield from self.release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.release(key, timerValues.getCurrentWatermarkInMs())

    def _keep(self, rows: pd.DataFrame) -> None:
        """Put rows into the state, as blocks of a sorted run."""
        run = pa.RecordBatch.from_pandas(rows.sort_values("event_us", kind="stable"), schema=self.schema, preserve_index=False)
        times = run.column("event_us").to_numpy()
        each = max(1, min(self.BLOCK_ROWS, self.BLOCK_BYTES * len(rows) // max(1, run.nbytes)))
        number = self.numbers.get()[0] if self.numbers.exists() else 0
        for first in range(0, len(rows), each):
            part = run.slice(first, each)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as writer:
                writer.write_batch(part)
            self.waiting.updateValue((number,), (sink.getvalue().to_pybytes(),))
            self.index.updateValue((number,), (int(times[first]), int(times[min(first + each, len(rows)) - 1])))
            number += 1
        self.numbers.update((number,))

    def _due(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Rows up to the watermark in spans in order; equal times are never parted."""
        upto = watermark * 1000
        blocks = sorted((v[0], k[0], v[1]) for k, v in self.index.iterator())
        blocks = [b for b in blocks if b[0] <= upto]
        held: list[pa.Table] = []
        rows = size = 0
        for place, (_, number, last) in enumerate(blocks):
            part = pa.ipc.open_stream(self.waiting.getValue((number,))[0]).read_all()
            self.waiting.removeKey((number,))
            self.index.removeKey((number,))
            if last > upto:
                rest = part.filter(pc.greater(part["event_us"], upto))
                part = part.filter(pc.less_equal(part["event_us"], upto))
                self._keep(rest.to_pandas())
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if place + 1 < len(blocks) and (rows >= self.SPAN_ROWS or size >= self.SPAN_BYTES):
                table, following = pa.concat_tables(held), blocks[place + 1][0]  # no later block has a row before it
                ready = table.filter(pc.less(table["event_us"], following))
                if ready.num_rows:
                    yield ready.to_pandas().sort_values(self.order, kind="stable", ignore_index=True)
                    table = table.filter(pc.greater_equal(table["event_us"], following)).combine_chunks()
                held, rows, size = [table], 0, 0  # what is left belongs to blocks that reach further
        if held and (table := pa.concat_tables(held)).num_rows:
            yield table.to_pandas().sort_values(self.order, kind="stable", ignore_index=True)

    def release(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        moved = False
        for span in self._due(watermark):
            moved = True
            yield from self.advance(key, span)
        yield from self.settle(key, watermark, moved)

    def advance(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Take rows in order."""
        raise NotImplementedError

    def settle(self, key, watermark: int, moved: bool) -> Iterator[pd.DataFrame]:
        """After the rows that were due, if there were any; ``watermark`` in milliseconds."""
        yield from ()

    def close(self) -> None:
        pass


def _plain(value):
    """A value as the state keeps it: arrays as lists, missing numbers as None."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value]
    if value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if isinstance(value, np.generic) else value


class _Cuts(InOrder):
    """Greedy cuts; the state is what is open. A group starts anew after ``gap_us`` of event time without rows."""

    def __init__(self, columns: T.StructType, order: list[str], rule: Budget | Gap, group: str, gap_us: int | None) -> None:
        super().__init__(columns, order)
        self.rule, self.group, self.gap_us = rule, group, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "value long, rows long, cuts long, last long")

    def spans(self, rows: pd.DataFrame) -> Iterator[tuple[bool, pd.DataFrame]]:
        """(whether what is open ends before them, rows) for runs of rows without a gap."""
        times = rows["event_us"].to_numpy()
        before = self.open.get()[3] if self.open.exists() else times[0]
        gaps = np.diff(times, prepend=before) > self.gap_us if self.gap_us is not None else np.zeros(len(times), bool)
        edges = [0, *(k for k in np.flatnonzero(gaps).tolist() if k), len(times)]
        for lo, hi in zip(edges, edges[1:]):
            yield bool(gaps[lo]), rows.iloc[lo:hi]

    def cut(self, rows: pd.DataFrame, carry: Open | None) -> tuple[np.ndarray, np.ndarray]:
        cuts, starts, carry = cut_rows(self.rule.prepare(lambda c: rows[c].to_numpy()), carry)
        self.open.update((int(carry.value), int(carry.rows), int(carry.cuts), int(rows["event_us"].iloc[-1])))
        return cuts, starts

    def carry(self) -> Open | None:
        return Open(*self.open.get()[:3]) if self.open.exists() else None

    def is_over(self, watermark: int) -> bool:
        """No row can come any more that does not start anew."""
        return self.gap_us is not None and self.open.exists() and self.open.get()[3] + self.gap_us <= watermark * 1000

    def advance(self, key, rows):
        for anew, span in self.spans(rows):
            cuts, starts = self.cut(span, None if anew else self.carry())
            yield span.drop(columns="event_us").assign(**{self.group: key[0], "_cut": cuts, "_starts": starts})

    def settle(self, key, watermark, moved):
        if moved and self.gap_us is not None:
            self.handle.registerTimer((self.open.get()[3] + self.gap_us) // 1000 + 1)
        elif not moved and self.is_over(watermark):
            self.open.clear()  # the state of a run that is over
        yield from ()


class _Packs(_Cuts):
    """Whole packs: their rows wait in the state until the next one starts, or a gap, or the end."""

    def __init__(self, columns, order, rule, group, gap_us: int | None, out: T.StructType) -> None:
        super().__init__(columns, order, rule, group, gap_us)
        self.out = out

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pack = handle.getListState("pack", self.columns)

    def advance(self, key, rows):
        names = self.columns.names
        if not self.open.exists():
            self.handle.registerTimer(_LAST_MS)  # for the pack that is open at the end
        for anew, span in self.spans(rows):
            if anew:
                yield from self.flush(key)
            before = self.carry()
            cuts, _ = self.cut(span, before)
            held = pd.DataFrame([tuple(r) for r in self.pack.get()], columns=names)
            numbers = np.concatenate([np.full(len(held), (before.cuts if before else 0) - 1, np.int64), cuts])
            every = pd.concat([held, span[names]], ignore_index=True) if len(held) else span[names].reset_index(drop=True)
            done = numbers < numbers[-1]
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()]
            for lo, hi in zip(edges, edges[1:]):  # numbers rise
                yield self.packed(key, int(numbers[lo]), every.iloc[lo:hi])
            self.pack.put([tuple(_plain(v) for v in r) for r in every[~done].itertuples(index=False, name=None)])

    def settle(self, key, watermark, moved):
        if moved and self.gap_us is not None:
            self.handle.registerTimer((self.open.get()[3] + self.gap_us) // 1000 + 1)
        if watermark > _LAST_MS or self.is_over(watermark):
            yield from self.flush(key)

    def flush(self, key) -> Iterator[pd.DataFrame]:
        """The open pack comes out; nothing fits it any more."""
        if self.pack.exists():
            _, _, cuts, last = self.open.get()
            yield self.packed(key, cuts - 1, pd.DataFrame([tuple(r) for r in self.pack.get()], columns=self.columns.names))
            self.pack.clear()
            self.open.update((self.rule.size + 1, 0, cuts, last))

    def packed(self, key, number: int, rows: pd.DataFrame) -> pd.DataFrame:
        kept = rows.drop(columns="event_us")
        items = [tuple(_plain(v) for v in r) for r in kept.itertuples(index=False, name=None)]
        fields = [dict(zip(kept.columns, r)) for r in items]
        return pd.DataFrame({self.group: [key[0]], "pack_no": [number], "items": [fields]})[self.out.names]


class _Known(InOrder):
    """Every step lists all tasks seen so far; the state is a map of tasks to their last values.

    A task without a value for ``forget_us`` of event time is dropped from the map, and no longer listed.
    """

    def __init__(self, columns, order, group: str, forget_us: int | None) -> None:
        super().__init__(columns, order)
        self.group, self.forget_us = group, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "task string", "value double, us long")

    def advance(self, key, rows):
        known = {k[0]: tuple(v) for k, v in self.known.iterator()}
        touched, lines = set(), []
        for step, here in rows.groupby("step", sort=True):
            us = int(here["event_us"].max())
            fresh = dict(zip(here["task"], here["value"]))
            known.update({t: (None if pd.isna(v) else float(v), us) for t, v in fresh.items() if not pd.isna(v) or t not in known})
            touched |= fresh.keys()
            if self.forget_us is not None:
                for task in [t for t, (_, u) in known.items() if u < us - self.forget_us]:
                    del known[task]
                    touched.add(task)
            lines += [(key[0], int(step), t, v, t not in fresh or pd.isna(fresh[t])) for t, (v, _) in sorted(known.items())]
            if len(lines) > 10_000:
                yield pd.DataFrame(lines, columns=[self.group, "step", "task", "value", "carried"])
                lines = []
        for task in touched:
            if task in known:
                self.known.updateValue((task,), known[task])
            elif self.known.containsKey((task,)):
                self.known.removeKey((task,))
        if lines:
            yield pd.DataFrame(lines, columns=[self.group, "step", "task", "value", "carried"])


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """Rows with a watermark and ``event_us``; markers move the watermark and go no further."""
    marked = rows.withWatermark(time, late).filter(F.col(time) < F.lit("2150-01-01").cast("timestamp"))
    return marked.withColumn("event_us", F.unix_micros(time))


def _waiting(rows: DataFrame, *names: str) -> T.StructType:
    return T.StructType([rows.schema[n] for n in dict.fromkeys([*names, "event_us"])])


def _micros(seconds: float | None) -> int | None:
    return None if seconds is None else int(seconds * 1_000_000)


def _ordered_cuts(
    rows: DataFrame, columns: list[str], order: list[str], rule: Budget | Gap, time: str, late: str, group: str, gap: float | None
) -> DataFrame:
    timed = _timed(rows, time, late)
    kept = _waiting(timed, *columns)
    out = T.StructType(
        [f for f in kept if f.name != "event_us"]
        + [rows.schema[group], T.StructField("_cut", T.LongType()), T.StructField("_starts", T.BooleanType())]
    )
    processor = _Cuts(kept, order, rule, group, _micros(gap))
    return timed.select(group, time, *kept.names).groupBy(group).transformWithStateInPandas(processor, out, "append", "eventTime")


def ordered_rate_limit(
    rows: DataFrame,
    interval: int,
    time: str = "ts",
    late: str = "1 hour",
    run: str = "run",
    forget: float | None = None,
    max_steps: int | None = None,
) -> DataFrame:
    """Rows that are logged, as by the batch operator: (run, step, t, force) with ``log_no``.

    ``t`` is the time in the unit of ``interval``, in the order of the column ``time``. A run without
    rows for more than ``forget`` seconds of event time starts anew, and its state is removed.
    """
    if max_steps is not None:
        rows = rows.withColumn("force", F.col("force") | (F.col("step") >= max_steps - 1))
    cuts = _ordered_cuts(rows, ["step", "t", "force"], ["t", "step"], Gap(interval), time, late, run, forget)
    return cuts.filter("_starts").withColumnRenamed("_cut", "log_no").drop("_starts")


def ordered_pack_numbers(
    sizes: DataFrame, max_len: int, time: str = "ts", late: str = "1 hour", shard: str = "shard", order: str = "idx", n: str = "n"
) -> DataFrame:
    """Next-fit pack number of each row, as by the batch operator; times rise with ``order``."""
    cuts = _ordered_cuts(sizes, [order, n], [order], Budget(max_len, column=n), time, late, shard, None)
    return cuts.withColumn("pack_no", F.col("_cut").cast("int")).drop("_cut", "_starts")


def ordered_last_known(
    values: DataFrame, time: str = "ts", late: str = "1 hour", run: str = "run", forget: float | None = None
) -> DataFrame:
    """(run, step, task, value, carried): at every step that occurs in a run, all its tasks seen so far.

    ``values``: run, time, step, task, value; a row per step and task, times in the order of steps and the same within a step. A task
    without rows for ``forget`` seconds of event time is no longer carried.
    """
    timed = _timed(values, time, late)
    kept = _waiting(timed, "step", "task", "value")
    out = T.StructType(
        [values.schema[run], T.StructField("step", T.LongType()), T.StructField("task", T.StringType())]
        + [T.StructField("value", T.DoubleType()), T.StructField("carried", T.BooleanType())]
    )
    processor = _Known(kept, ["step", "task"], run, _micros(forget))
    return timed.select(run, time, *kept.names).groupBy(run).transformWithStateInPandas(processor, out, "append", "eventTime")


SAMPLE_FIELDS = ("input_ids", "user_len", "task_id", "task_type")


def ordered_packs(
    samples: DataFrame, max_len: int, time: str = "ts", late: str = "1 hour", shard: str = "shard", order: str = "idx", idle: float | None = None
) -> DataFrame:
    """Next-fit packs as they are finished: (shard, pack_no, items), items in order.

    ``samples``: shard, ``order``, n and the fields of a sample; times rise with ``order``. The pack that is open
    ends when no row follows for more than ``idle`` seconds of event time, and at the end of the input. :func:`pack_rows`
    joins the tokens of a pack.
    """
    timed = _timed(samples, time, late)
    kept = _waiting(timed, order, "n", *SAMPLE_FIELDS)
    item = T.StructType([f for f in kept if f.name != "event_us"])
    out = T.StructType([samples.schema[shard], T.StructField("pack_no", T.LongType()), T.StructField("items", T.ArrayType(item))])
    processor = _Packs(kept, [order], Budget(max_len), shard, _micros(idle), out)
    return timed.select(shard, time, *kept.names).groupBy(shard).transformWithStateInPandas(processor, out, "append", "eventTime")


def pack_rows(packs: DataFrame, shard: str = "shard", order: str = "idx", is_sft: bool = False) -> DataFrame:
    """Finished packs with their tokens, labels and offsets, as the batch operator makes them. No row leaves its partition."""
    items = F.transform("items", lambda x: F.struct(x[order].alias(order), *[x[f].alias(f) for f in SAMPLE_FIELDS]))
    return join_items(packs.withColumn("s", F.sort_array(items)), shard, "pack_no", is_sft=is_sft)


def with_markers(stream: DataFrame) -> tuple[DataFrame, str]:
    """The stream with an empty stream of markers beside it, and the folder of the markers."""
    spark = stream.sparkSession
    folder = stage_path(spark, "markers")
    spark.createDataFrame([], stream.schema).coalesce(1).write.parquet(folder)
    markers = spark.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(markers), folder


def write_marker(spark: SparkSession, folder: str, schema: T.StructType, time: str = "ts") -> None:
    """Put the row behind the stream that ends it: all columns but the time are null."""
    row = [MARKER if f.name == time else None for f in schema]
    blank = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    spark.createDataFrame([tuple(row)], blank).coalesce(1).write.mode("append").parquet(folder)


def drain_in_order(stream: DataFrame, operator, name: str, time: str = "ts") -> DataFrame:
    """Run an operator over all input there is, let the watermark pass the last rows, and read what was written.

    ``operator`` turns the stream into a stream of results. Both runs go to one checkpoint and one folder.
    """
    spark = stream.sparkSession
    both, folder = with_markers(stream)
    out = operator(both)
    with state_store(spark):
        path = drain_to_path(out, name)
        write_marker(spark, folder, stream.schema, time)
        drain_to_path(out, name, path)
    return spark.read.schema(out.schema).parquet(path)
