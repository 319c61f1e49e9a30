"""Greedy cuts against the plain sequential rule, with one group holding most rows."""

import random

import pytest

from sparkloom.operators.greedy import Budget, Gap, greedy_cuts


def sequential_budget(sizes, size, rows):
    out, used, held, cut = [], None, 0, -1
    for n in sizes:
        if used is not None and used + n <= size and (rows is None or held < rows):
            used, held = used + n, held + 1
            out.append(cut)
        else:
            parts = max(1, -(-n // size))
            out.append(cut + 1)
            cut += parts
            used, held = n - (parts - 1) * size, 1
    return out


def sequential_gap(times, forced, interval):
    last, cut, out = times[0], -1, []
    for t, f in zip(times, forced):
        if t - last > interval or f:
            last, cut = t, cut + 1
        out.append(cut)
    return out


@pytest.mark.parametrize(
    "size,rows,largest,chunks,piece",
    [(100, None, 100, 7, 40), (100, 5, 60, 9, 31), (50, None, 170, 6, 1000), (1000, None, 20, 9, 25), (64, 3, 200, 5, 17)],
)
def test_budget(spark, size, rows, largest, chunks, piece):
    rng = random.Random(size * 31 + chunks)
    data = [(rng.choice([0, 0, 0, 0, 1, 2]), i, rng.randint(1, largest)) for i in range(2000)]
    frame = spark.createDataFrame(data, "g int, o int, n int")
    got = greedy_cuts(frame, "g", ["o"], Budget(size, rows), chunks=chunks, piece_rows=piece).toPandas()
    assert len(got) == len(data)
    for g in (0, 1, 2):
        want = sequential_budget([r[2] for r in data if r[0] == g], size, rows)
        assert got[got.g == g].sort_values("o")._cut.tolist() == want


@pytest.mark.parametrize("interval,often", [(50, 0.01), (5, 0.0), (500, 0.001), (0, 0.0)])
def test_gap(spark, interval, often):
    rng = random.Random(interval)
    t, data = 0, []
    for i in range(2000):
        t += rng.randint(0, 5)
        data.append((rng.choice(["a", "a", "b"]), t, i, rng.random() < often))
    frame = spark.createDataFrame(data, "g string, t long, o int, force boolean")
    got = greedy_cuts(frame, "g", ["t", "o"], Gap(interval), chunks=8, piece_rows=53).toPandas()
    for g in ("a", "b"):
        mine = [r for r in data if r[0] == g]
        want = sequential_gap([r[1] for r in mine], [r[3] for r in mine], interval)
        assert got[got.g == g].sort_values(["t", "o"])._cut.tolist() == want


def test_empty(spark):
    frame = spark.createDataFrame([], "g int, o int, n int")
    assert greedy_cuts(frame, "g", ["o"], Budget(10)).count() == 0
