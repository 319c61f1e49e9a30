import math
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm import vector_queries, whitening

SCHEMA = "vec_id long, embedding array<float>, mark string, x string, n int, width int"
RULE = whitening.Whitening(components=4)
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "m", "x", 1, 2) for i, v in rows], SCHEMA).repartition(4)


def vectors(n, d, seed=1):
    rng = np.random.RandomState(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)


def brute(x, weights, k):
    """Whitened vectors of whole numbers, components by falling variance, and their shares."""
    n = int(weights.sum())
    sums = (x * weights[:, None]).sum(axis=0)
    centred = x - sums / n
    covariance = (centred * weights[:, None]).T @ centred / n
    values, lines = np.linalg.eigh(covariance)
    values, lines = values[::-1][:k], lines[:, ::-1][:, :k]
    return n, sums, centred @ lines / np.sqrt(values), values / np.trace(covariance)


def compare(got, ids, x, weights, k):
    n, sums, want, shares = brute(x, weights, k)
    rows = {r.vec_id: r for r in got}
    z = np.array([rows[i].whitened for i in ids])
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-7
    assert np.abs(z @ z.T - want @ want.T).max() < 1e-6  # one sign for all rows
    for i, line in zip(ids, x.tolist()):
        assert rows[i].n == n
        assert rows[i].deviation == sum((n * a - int(s)) ** 2 for a, s in zip(line, sums))
        assert np.abs(np.array(rows[i].explained) - shares).max() < 1e-9
        assert rows[i].identity_error < 1e-9


def whole(v):
    return np.floor(np.asarray(v, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000


def test_copies_weigh_as_often_as_they_stand(spark):
    v = vectors(200, 6)
    rows = [(i, row.tolist()) for i, row in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(150)]
    got = whitening.whiten(frame(spark, rows), RULE).collect()
    x = whole(np.vstack([v, np.repeat(v[:1], 150, axis=0)]))
    compare(got, [i for i, _ in rows], x, np.ones(len(x), np.int64), 4)


def test_copies_weigh_once(spark):
    v = vectors(200, 6)
    rows = [(i, row.tolist()) for i, row in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(150)]
    got = whitening.whiten(frame(spark, rows), whitening.Whitening(components=4, by_count=False)).collect()
    compare([r for r in got if r.vec_id < 1000], list(range(200)), whole(v), np.ones(200, np.int64), 4)
    assert len({tuple(r.whitened) for r in got if r.vec_id >= 1000} | {tuple(r.whitened) for r in got if r.vec_id == 0}) == 1


def test_edge_cases(spark):
    v = vectors(50, 3).tolist()
    bad = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 1.0, 1.0], [1e30, 0.0, 0.0]]
    rows = list(enumerate(v)) + [(900 + k, b) for k, b in enumerate(bad)] + [(None, v[0]), (3, v[3]), (3, v[4])]
    rows += [(2000 + k, [float(k), 1.0]) for k in range(10)]
    got = whitening.whiten(frame(spark, rows), RULE).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted(
        (i is None, i or 0) for i, x in rows if i is None or not 900 <= i < 906
    )
    # another length is a fit of its own, with one component that varies
    other = [r for r in got if r.vec_id is not None and r.vec_id >= 2000]
    assert {r.n for r in other} == {10} and {len(r.whitened) for r in other} == {1}
    assert {r.n for r in got if r not in other} == {53}


def test_one_vector_has_no_components(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), RULE)
    assert [(r.n, r.deviation, list(r.whitened)) for r in got.collect()] == [(2, 0, [])] * 2
    assert whitening.component_rows(got).collect() == []


def test_empty_table(spark):
    assert whitening.whiten(frame(spark, []), RULE).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)]), RULE).collect() == []


def test_deviation_of_large_numbers_is_exact_or_null():
    x = np.array([[1 << 40, 3], [0, 1]], np.int64)
    fit = whitening.Fit(2, x.sum(axis=0).tolist())
    assert fit.deviations(x) == [None, None]
    x = np.array([[1 << 30, 3], [0, 1]], np.int64)
    fit = whitening.Fit(2, x.sum(axis=0).tolist())
    assert fit.deviations(x) == [(1 << 60) + 4] * 2


def test_mean_beside_large_numbers():
    """Centring keeps what a plain mean in doubles would lose."""
    x = np.array([[(1 << 52) + k] for k in (0, 1, 1)], np.int64)
    fit = whitening.Fit(3, [int(x.sum())])
    want = [float(Fraction(int(v)) - Fraction(int(x.sum()), 3)) for v in x[:, 0]]
    assert fit.centred(x)[:, 0].tolist() == pytest.approx(want, rel=1e-15)


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in table], whole([r.embedding for r in table])
    got = vector_queries.op11_whitening(spark, SF)
    assert got.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
        ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    rows = got.collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c) for i in sorted(ids) for c in range(1, 33)]
    n, sums, want, shares = brute(x, np.ones(len(x), np.int64), 32)
    place = {i: k for k, i in enumerate(ids)}
    z = np.empty_like(want)
    for r in rows:
        z[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and abs(r.explained - shares[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        assert r.deviation == int(((n * x[place[r.vec_id]] - sums) ** 2).sum())
    signs = np.sign((z * want).sum(axis=0))
    assert np.abs(z * signs - want).max() < 1e-7
