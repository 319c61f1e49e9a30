"""Embedding whitening over distinct vectors, weighted by how often they occur.

Entries become whole numbers, and rows with the same numbers are one vector with a count. The means, the
covariance and the whitened vectors are worked out over distinct vectors, so a vector with a billion copies costs as much as any
other, and the result is joined back to the rows.

The covariance is a weighted product of centred blocks. Entries are first centred, as whole numbers, at the whole number
nearest to the mean; what is left of the mean is less than one and is taken off as a double, so nothing is lost
between large numbers. Every task gives one matrix, and the partial sums of an entry are added exactly rounded, so
that reruns agree. The driver holds one matrix per length of vectors: its size is that of a vector, squared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.common import require
from sparkloom.operators.lookups import split_join
from sparkloom.session import stage

_KINDS = (np.int8, np.int16, np.int32, np.int64)
_EXACT = float(1 << 52)


@dataclass(frozen=True)
class Whitening:
    """Entry c becomes floor(scale * c) + shift. ``components`` are kept at most; copies count as
    often as they occur, or once unless ``by_count``. A component whose variance is below ``least`` of the largest is none.

    ``max_entries`` bounds the matrices that the driver holds: the sum of the squared lengths that occur.
    """

    scale: float = 64.0
    shift: int = 1_000_000
    components: int = 32
    by_count: bool = True
    least: float = 1e-12
    max_entries: int = 1 << 26


@dataclass
class Fit:
    """What vectors of one length are whitened by."""

    n: int
    sums: list[int]
    pivot: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)
    trace: float = 0.0
    identity_error: float = 0.0

    def __post_init__(self) -> None:
        # the whole number nearest to each mean, and what the sums exceed it by
        self.pivot = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        self.excess = [s - self.n * int(p) for s, p in zip(self.sums, self.pivot)]
        self.rest = np.array([e / self.n for e in self.excess])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot) - self.rest

    def solve(self, covariance: np.ndarray, rule: Whitening) -> None:
        """Eigenvectors, the largest value first; the first entry that is not small is positive."""
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        self.trace = float(np.trace(covariance))
        kept = np.flatnonzero(values[::-1] > max(0.0, rule.least * float(values[-1])))[: rule.components]
        self.values, vectors = values[::-1][kept], vectors[:, ::-1][:, kept]
        lead = np.argmax(np.abs(vectors) > 1e-6, axis=0)
        self.vectors = vectors * np.where(vectors[lead, np.arange(len(kept))] < 0, -1.0, 1.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of every row, exact; None where it is too large for 64 bits.

        With d = x - pivot this is n*n times the sum of d*d, less 2*n times that of d * excess, and the sum of excess squared.
        """
        d = x - self.pivot
        size = int(np.abs(d).max()) if d.size else 0
        wide = d if size * size * d.shape[1] < 1 << 62 else d.astype(object)
        squares = (wide * wide).sum(axis=1).tolist()
        most = max(map(abs, self.excess), default=0)
        wide = d if size * most * d.shape[1] < 1 << 62 else d.astype(object)
        excess = np.array(self.excess, np.int64 if wide is d else object)
        mixed = (wide * excess).sum(axis=1).tolist()
        last = sum(e * e for e in self.excess)
        found = (self.n * self.n * s - 2 * self.n * m + last for s, m in zip(squares, mixed))
        return [v if v < 1 << 63 else None for v in found]


def _narrow(x: np.ndarray) -> list[bytes]:
    """Each row of whole numbers in as few bytes an entry as do; the first byte says how many."""
    low, high = x.min(axis=1), x.max(axis=1)
    place = np.full(len(x), len(_KINDS) - 1)
    for k in range(len(_KINDS) - 1, -1, -1):
        place[(low >= np.iinfo(_KINDS[k]).min) & (high <= np.iinfo(_KINDS[k]).max)] = k
    out: list[bytes] = [b""] * len(x)
    for k in np.unique(place).tolist():
        rows = np.flatnonzero(place == k)
        size = x.shape[1] * _KINDS[k]().itemsize
        data, first = x[rows].astype(_KINDS[k]).tobytes(), bytes([k])
        for at, row in enumerate(rows.tolist()):
            out[row] = first + data[at * size : (at + 1) * size]
    return out


def _wide(packed: list[bytes], shift: int) -> np.ndarray:
    return np.stack([np.frombuffer(p, _KINDS[p[0]], -1, 1) for p in packed]).astype(np.int64) + shift


def whole_numbers(column: pa.Array, scale: float, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * entry) as 64 bits) per length, of vectors whose entries are all there and below ``most``."""
    offsets = column.offsets.to_numpy()
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        scaled = np.floor(entries[offsets[rows][:, None] + np.arange(width)] * scale)
        good = (np.abs(scaled) < most).all(axis=1)  # false for NaN too
        if good.any():
            yield rows[good], scaled[good].astype(np.int64)


def _numbered(rule: Whitening, with_vector: bool):
    """Batches of (id, vector) to (mark, width, x) or (id, mark): x in narrow form, mark its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1), rule.scale, _EXACT):
                packed = _narrow(x)
                marks = pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary())
                if with_vector:
                    widths = pa.array([x.shape[1]] * len(x), pa.int32())
                    yield pa.record_batch([marks, widths, pa.array(packed, pa.binary())], names=["mark", "width", "x"])
                else:
                    yield pa.record_batch([batch.column(0).take(pa.array(rows)), marks], names=["id", "mark"])

    return run


def distinct_vectors(rows: DataFrame, rule: Whitening = Whitening(), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(mark, width, x, n): the distinct vectors of whole numbers, and how many rows have each."""
    pairs = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    numbers = pairs.mapInArrow(_numbered(rule, True), "mark binary, width int, x binary")
    return numbers.groupBy("mark", "width", "x").agg(F.count("*").alias("n"))


def _by_width(batch: pa.RecordBatch, rule: Whitening) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, places, x, weights) of the vectors of a batch of (mark, width, x, n)."""
    widths = batch.column("width").to_numpy(zero_copy_only=False)
    packed, counts = batch.column("x").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
    for width in np.unique(widths).tolist():
        places = np.flatnonzero(widths == width)
        weights = counts[places] if rule.by_count else np.ones(len(places), np.int64)
        yield width, places, _wide([packed[k] for k in places], rule.shift), weights


def _sums(rule: Whitening):
    """Batches to (width, place, total, n): exact sums of this task as decimal text; place -1 has the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for width, _, x, weights in _by_width(batch, rule):
                safe = int(np.abs(x).max()) * int(weights.sum()) < 1 << 62
                part = (x * weights[:, None]).sum(axis=0) if safe else (x.astype(object) * weights[:, None].astype(object)).sum(axis=0)
                held = total.setdefault(width, [0] * (width + 1))
                for k, v in enumerate([int(weights.sum()), *part.tolist()]):
                    held[k] += v
        lines = [(w, k - 1, str(v)) for w, held in total.items() for k, v in enumerate(held)]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines)], names=["width", "place", "total"])

    return run


def _products(rule: Whitening, fits: dict[int, Fit], whiten: bool):
    """Batches to (width, line, task, entries): this task's weighted product of centred vectors, line by line.

    With ``whiten`` of their whitened vectors, and a line -1 with their weighted sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x, weights in _by_width(batch, rule):
                fit = fits[width]
                rows = fit.whitened(x) if whiten else fit.centred(x)
                part = np.vstack([weights @ rows, (rows * weights[:, None]).T @ rows])
                total[width] = total[width] + part if width in total else part
        for width, matrix in total.items():
            size = len(matrix)
            yield pa.record_batch(
                [pa.array([width] * size), pa.array(range(-1, size - 1)), pa.array(list(matrix), pa.list_(pa.float64()))],
                names=["width", "line", "entries"],
            )

    return run


def _added(lines: pd.DataFrame) -> pd.DataFrame:
    """The partial sums of one line, a row per task, added with one rounding."""
    entries = [math.fsum(column) for column in zip(*lines["entries"])]
    return pd.DataFrame({"width": lines["width"].iloc[:1], "line": lines["line"].iloc[:1], "entries": [entries]})


_LINES = "width long, line long, entries array<double>"


def _covariances(vectors: DataFrame, rule: Whitening, fits: dict[int, Fit], whiten: bool) -> dict[int, np.ndarray]:
    """Covariance per width: lines of the matrices come to the driver, as long as a vector."""
    partial = vectors.mapInArrow(_products(rule, fits, whiten), _LINES)
    lines = partial.groupBy("width", "line").applyInPandas(_added, _LINES).collect()
    found: dict[int, np.ndarray] = {}
    for width in {r["width"] for r in lines}:
        n = fits[width].n
        matrix = np.array([r["entries"] for r in sorted((r for r in lines if r["width"] == width), key=lambda r: r["line"])])
        mean = matrix[0] / n  # zero up to rounding
        found[width] = matrix[1:] / n - np.outer(mean, mean)
    return found


def fit_whitening(vectors: DataFrame, rule: Whitening = Whitening()) -> dict[int, Fit]:
    """A fit per length of vectors. ``vectors`` is a written table of :func:`distinct_vectors`, read three times."""
    sums = (
        vectors.mapInArrow(_sums(rule), "width long, place long, total string")
        .groupBy("width", "place")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    totals: dict[int, dict[int, int]] = {}
    for r in sums.limit(rule.max_entries).collect():
        totals.setdefault(r["width"], {})[r["place"]] = int(r["total"])
    if sum(w * w for w in totals) > rule.max_entries:
        raise ValueError("vectors too long, or of too many lengths, for a covariance on the driver")
    fits = {w: Fit(t[-1], [t[k] for k in range(w)]) for w, t in totals.items()}
    for width, covariance in _covariances(vectors, rule, fits, False).items():
        fits[width].solve(covariance, rule)
    for width, covariance in _covariances(vectors, rule, fits, True).items():
        off = covariance - np.eye(len(covariance))
        fits[width].identity_error = float(np.abs(off).max()) if off.size else 0.0
    return fits


def _finished(rule: Whitening, fits: dict[int, Fit]):
    """Batches of (mark, width, x, n) to (mark, width, deviation, whitened): each distinct vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, places, x, _ in _by_width(batch, rule):
                fit = fits[width]
                yield pa.record_batch(
                    [
                        batch.column("mark").take(pa.array(places)),
                        pa.array([width] * len(places)),
                        pa.array(fit.deviations(x), pa.int64()),
                        pa.array(list(fit.whitened(x)), pa.list_(pa.float64())),
                    ],
                    names=["mark", "width", "deviation", "whitened"],
                )

    return run


def whiten(
    rows: DataFrame, rule: Whitening = Whitening(), id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(``id_col``, n, deviation, whitened, explained, identity_error): a row per vector, components as arrays.

    ``n`` is the weight of the fit list, ``deviation`` the sum over dimensions of (n * x - S) ** 2, S the sums of the fit
    list, exact, or null where it has more than 64 bits. ``explained`` is each component's share of the variance,
    ``identity_error`` the largest absolute entry of the whitened vectors' covariance less the identity.

    Defined results: vectors that are null, empty, hold a null, NaN or infinite entry, or one too large to be scaled to a
    whole number exactly (2**52) take no part. Vectors of different lengths are fits of their own. Repeated rows count as
    often as they stand (or once, see :class:`Whitening`) and each get their result, rows with a null id too. A component
    without variance is none, so a single vector has no components, and empty arrays. Other columns are not read. An
    empty table gives no rows. Jobs run when this is called.
    """
    require(rows, id_col, vector)
    spark = rows.sparkSession
    vectors = stage(distinct_vectors(rows, rule, id_col, vector), "vectors")
    found = fit_whitening(vectors, rule)
    schema = "mark binary, width long, deviation long, whitened array<double>"
    finished = stage(vectors.mapInArrow(_finished(rule, found), schema), "whitened")
    pairs = rows.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    marks = pairs.mapInArrow(_numbered(rule, False), f"id {pairs.schema['id'].dataType.simpleString()}, mark binary")
    # a vector that many rows share meets them by broadcast, all others by a shuffle
    joined = split_join(marks, finished, "mark")
    facts = spark.createDataFrame(
        [(w, f.n, [float(v) / f.trace for v in f.values], f.identity_error) for w, f in found.items()],
        "width long, n long, explained array<double>, identity_error double",
    )
    return joined.join(F.broadcast(facts), "width").select(  # a row per length
        F.col("id").alias(id_col), "n", "deviation", "whitened", "explained", "identity_error"
    )


def component_rows(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row per vector and component, numbered from 1."""
    pairs = F.arrays_zip(F.col("whitened"), F.col("explained"))
    return whitened.select(id_col, "n", "deviation", "identity_error", F.posexplode(pairs).alias("place", "pair")).select(
        id_col,
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"),
        "identity_error",
    )
