"""Exact greedy cuts over an ordered stream, spread over chunks.

Next-fit packing, budgeted batches and rate-limited logging share one shape: rows
come in order, a *cut* starts at some row, and the next cut is the first later
row that the open one cannot take. The rule is sequential, but what an earlier
chunk can do to a later one is only *where its first cut falls*; starts that
fall close together soon meet in the same later cuts. So, with a chunk read in pieces of a fixed number of rows:

1. every piece reports, for each possible first cut, how many cuts follow and
   what stays open at its end (equal neighbours merged);
2. these reports, at most two per piece, are folded per group;
3. every piece then cuts its own rows, given what was open when it began.

No group is ever collected: a shard holding all rows is still many pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.operators.ordering import ordered_chunks

_LOWEST = np.iinfo(np.int64).min // 4


@dataclass(frozen=True)
class Open:
    """What is open between two rows: amount used (or last time), rows, cuts so far."""

    value: int
    rows: int
    cuts: int


@dataclass(frozen=True)
class Budget:
    """A cut takes rows while their sizes stay within ``size`` and their number within ``rows``.

    A row larger than the budget only ever opens a cut; it fills whole cuts and
    leaves the rest of itself as the start of the last one.
    """

    size: int
    rows: int | None = None
    column: str = "n"

    def prepare(self, column: Callable[[str], np.ndarray]) -> "_BudgetRun":
        return _BudgetRun(self, column(self.column).astype(np.int64))


class _BudgetRun:
    def __init__(self, rule: Budget, n: np.ndarray):
        self.m, self.rule = len(n), rule
        self.upto = np.cumsum(n)
        self.axis = np.concatenate(([0], self.upto))  # size before each row, then the total
        self.parts = np.maximum(1, -(-n // rule.size))
        self.rest = n - (self.parts - 1) * rule.size
        first_over = np.searchsorted(self.upto, rule.size - self.rest + self.upto, side="right")
        rows = np.arange(self.m)
        self.next = np.maximum(rows + 1, first_over)
        if rule.rows is not None:
            self.next = np.minimum(self.next, rows + rule.rows)

    def last_candidate(self) -> int:
        last = int(np.searchsorted(self.upto, self.rule.size, side="right"))
        return last if self.rule.rows is None else min(last, self.rule.rows)

    def entry(self, carry: Open | None) -> int:
        if carry is None:
            return 0
        j = int(np.searchsorted(self.upto, self.rule.size - carry.value, side="right"))
        return j if self.rule.rows is None else min(j, self.rule.rows - carry.rows)

    def open_at_end(self, start: int) -> tuple[int, int]:
        return int(self.rest[start] + self.upto[-1] - self.upto[start]), self.m - start

    def through(self, carry: Open) -> Open:
        return Open(carry.value + int(self.upto[-1]), carry.rows + self.m, carry.cuts)

    @staticmethod
    def limit(rule: Budget, carry: Open) -> int:
        return rule.size - carry.value


@dataclass(frozen=True)
class Gap:
    """A cut at the first row more than ``interval`` after the last cut, or at a forced row.

    The clock of a group starts at its first row.
    """

    interval: int
    column: str = "t"
    forced: str = "force"

    def prepare(self, column: Callable[[str], np.ndarray]) -> "_GapRun":
        return _GapRun(self, column(self.column).astype(np.int64), column(self.forced).astype(bool))


class _GapRun:
    def __init__(self, rule: Gap, t: np.ndarray, forced: np.ndarray):
        self.m, self.rule, self.t = len(t), rule, t
        self.axis = np.concatenate(([_LOWEST], t))  # time of the row before
        self.parts = np.ones(self.m, dtype=np.int64)
        stops = np.append(np.flatnonzero(forced), self.m)
        rows = np.arange(self.m)
        self.first_stop = int(stops[0])
        due = np.searchsorted(t, t + rule.interval, side="right")
        self.next = np.minimum(np.maximum(rows + 1, due), stops[np.searchsorted(stops, rows, side="right")])

    def last_candidate(self) -> int:
        due = int(np.searchsorted(self.t, self.t[0] + self.rule.interval, side="right"))
        return min(due, self.first_stop)

    def entry(self, carry: Open | None) -> int:
        last = int(self.t[0]) if carry is None else carry.value
        return min(int(np.searchsorted(self.t, last + self.rule.interval, side="right")), self.first_stop)

    def open_at_end(self, start: int) -> tuple[int, int]:
        return int(self.t[start]), 0

    def through(self, carry: Open) -> Open:
        return carry

    @staticmethod
    def limit(rule: Gap, carry: Open) -> int:
        return carry.value + rule.interval


def cut_rows(run, carry: Open | None) -> tuple[np.ndarray, np.ndarray, Open | None]:
    """Cut number and start flag per row of one run, and what is open at its end.

    Rows that precede every cut of their group get number -1.
    """
    entry = run.entry(carry)
    base = 0 if carry is None else carry.cuts
    starts, number, s = [], [], entry
    count = base
    while s < run.m:
        starts.append(s)
        number.append(count)
        count += int(run.parts[s])
        s = int(run.next[s])
    begun = np.zeros(run.m, dtype=bool)
    begun[starts] = True
    which = np.cumsum(begun) - 1
    ends = np.array([n + int(run.parts[s]) - 1 for n, s in zip(number, starts)] or [0], dtype=np.int64)
    cuts = np.where(which >= 0, ends[which.clip(min=0)], base - 1)
    cuts[starts] = number  # a start that fills several cuts is listed under its first
    if not starts:
        if carry is None:
            carry = Open(int(run.t[0]), 0, 0)
        return cuts, begun, run.through(carry)
    value, rows = run.open_at_end(starts[-1])
    return cuts, begun, Open(value, rows, count)


def _runs(values: pa.Array) -> list[tuple[int, int]]:
    """Bounds of equal neighbours."""
    changes = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
    edges = np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1
    bounds = [0, *edges.tolist(), len(values)]
    return list(zip(bounds[:-1], bounds[1:]))


def _column(batch: pa.RecordBatch) -> Callable[[str], np.ndarray]:
    return lambda name: batch.column(name).to_numpy(zero_copy_only=False)


def _report(run) -> dict:
    """Outcome of each possible first cut of a run; equal neighbours merged."""
    known: dict[int, tuple[int, int]] = {}
    classes: list[tuple] = []
    last = min(run.last_candidate(), run.m)
    for j in range(last + 1):
        if j == run.m:
            outcome = (-1, 0)
        else:
            walk, s = [], j
            while s < run.m and s not in known:
                walk.append(s)
                s = int(run.next[s])
            for s in reversed(walk):
                after = int(run.next[s])
                tail, cuts = known[after] if after < run.m else (s, 0)
                known[s] = (tail, cuts + int(run.parts[s]))
            outcome = known[j]
        if not classes or classes[-1][2] != outcome:
            classes.append((j, int(run.axis[j]), outcome))
    value, rows, cuts = [], [], []
    for _, _, (tail, n) in classes:
        v, r = run.open_at_end(tail) if tail >= 0 else (0, 0)
        value.append(v)
        rows.append(r)
        cuts.append(n if tail >= 0 else -1)  # -1: the open cut takes the whole run
    return {
        "start": [c[0] for c in classes],
        "axis": [c[1] for c in classes],
        "value": value,
        "open_rows": rows,
        "cuts": cuts,
        "m": run.m,
        "total": int(run.axis[-1]),
        "head": int(getattr(run, "t", [0])[0]),
    }


def _step(rule, row, carry: Open | None) -> Open:
    """Carry one report forward, as :func:`cut_rows` would do on its rows."""
    gap = isinstance(rule, Gap)
    if carry is None and not gap:
        k = 0
        cuts = 0
    else:
        if carry is None:
            carry = Open(int(row.head), 0, 0)
        limit = (_GapRun if gap else _BudgetRun).limit(rule, carry)
        k = int(np.searchsorted(np.asarray(row.axis), limit, side="right")) - 1
        if not gap and rule.rows is not None:
            k = min(k, int(np.searchsorted(np.asarray(row.start), rule.rows - carry.rows, side="right")) - 1)
        cuts = carry.cuts
    if row.cuts[k] < 0:
        return carry if gap else Open(carry.value + int(row.total), carry.rows + int(row.m), carry.cuts)
    return Open(int(row.value[k]), int(row.open_rows[k]), cuts + int(row.cuts[k]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole pieces of one partition, in order, from its Arrow batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        for lo, hi in _runs(batch.column("_piece")):
            part = batch.slice(lo, hi - lo)
            if held and held[-1].column("_piece")[0] != part.column("_piece")[0]:
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def greedy_cuts(
    df: DataFrame, group: str, order: list, rule: Budget | Gap, chunks: int | None = None, piece_rows: int = 1_000_000
) -> DataFrame:
    """Add ``_cut`` (0-based number in the group) and ``_starts`` to every row.

    Pass only the columns the rule and the caller need. A task holds one piece of at
    most ``piece_rows`` rows at a time, however large its partition is.
    """
    return cut_chunks(ordered_chunks(df, group, *order, chunks=chunks), group, rule, piece_rows)


def cut_chunks(chunked: DataFrame, group: str, rule: Budget | Gap, piece_rows: int = 1_000_000) -> DataFrame:
    """:func:`greedy_cuts` of rows that already lie in ordered chunks, group by group.

    Rows may have been filtered, and columns added without a shuffle, since the
    chunks were made.
    """
    piece = F.col("_chunk").cast("bigint") * (1 << 32) + F.floor(F.col("_row") / piece_rows)
    df = chunked.drop("_chunk", "_row")
    rows = chunked.withColumn("_piece", piece).drop("_chunk", "_row")
    group_type = df.schema[group].dataType
    longs = T.ArrayType(T.LongType())
    report_schema = T.StructType(
        [T.StructField(group, group_type), T.StructField("_piece", T.LongType())]
        + [T.StructField(c, longs) for c in ("start", "axis", "value", "open_rows", "cuts")]
        + [T.StructField(c, T.LongType()) for c in ("m", "total", "head")]
    )
    needed = [group, "_piece", rule.column] + ([rule.forced] if isinstance(rule, Gap) else [])

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            spans = _runs(piece.column(group))
            # only the first and the last group of a piece can reach into another piece
            for lo, hi in {spans[0], spans[-1]}:
                part = piece.slice(lo, hi - lo)
                outcome = _report(rule.prepare(_column(part)))
                keys = [part.column(group).slice(0, 1), part.column("_piece").slice(0, 1)]
                lists = [pa.array([outcome[c]], pa.list_(pa.int64())) for c in ("start", "axis", "value", "open_rows", "cuts")]
                totals = [pa.array([outcome[c]], pa.int64()) for c in ("m", "total", "head")]
                yield pa.RecordBatch.from_arrays(keys + lists + totals, names=report_schema.names)

    carry_schema = T.StructType(
        [T.StructField("_g", group_type)] + [T.StructField(c, T.LongType()) for c in ("_p", "_value", "_rows", "_cuts")]
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, carry = [], None
        for row in pdf.sort_values("_piece").itertuples(index=False):
            if carry is not None:
                out.append((row[0], row[1], carry.value, carry.rows, carry.cuts))
            carry = _step(rule, row, carry)
        return pd.DataFrame(out, columns=carry_schema.names)

    carries = (
        rows.select(*needed)
        .mapInArrow(reports, report_schema)
        .groupBy(group)
        .applyInPandas(fold, carry_schema)
    )
    # at most two rows per piece of a million, so the broadcast is small at any scale
    carried = rows.join(
        F.broadcast(carries), (F.col(group) == F.col("_g")) & (F.col("_piece") == F.col("_p")), "left"
    ).select(*df.columns, "_piece", "_value", "_rows", "_cuts")
    out_schema = T.StructType(
        df.schema.fields + [T.StructField("_cut", T.LongType()), T.StructField("_starts", T.BooleanType())]
    )
    columns = df.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            cut_no = np.empty(piece.num_rows, dtype=np.int64)
            starts = np.empty(piece.num_rows, dtype=bool)
            for lo, hi in _runs(piece.column(group)):
                part = piece.slice(lo, hi - lo)
                known = [part.column(c)[0].as_py() for c in ("_value", "_rows", "_cuts")]
                carry = None if known[0] is None else Open(*known)
                cut_no[lo:hi], starts[lo:hi], _ = cut_rows(rule.prepare(_column(part)), carry)
            kept = [piece.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(cut_no), pa.array(starts)], names=out_schema.names)

    return carried.mapInArrow(assign, out_schema)
