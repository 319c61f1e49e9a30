import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, block int, chunk long, cluster int, distance string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA).repartition(4)


def kept(rule, v):
    return v is not None and len(v) == rule.dimension and all(
        x is not None and math.isfinite(x) and abs(math.floor(rule.scale * x)) < rule.most for x in v
    )


def brute(rows, rule):
    """Plain Lloyd on whole numbers: rows (id, cluster, distance) and centroids."""
    rows = [(i, [math.floor(rule.scale * float(np.float32(x))) for x in v]) for i, v in rows if kept(rule, v)]
    named = sorted((hashlib.sha256(f"{rule.seed}:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)
    centres = [x for _, x in named[: rule.clusters]]
    if not centres:
        return [], []

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rule.rounds):
        chosen = [nearest(x)[1] for _, x in rows]
        for k in range(len(centres)):
            mine = [x for (_, x), c in zip(rows, chosen) if c == k]
            if mine:
                centres[k] = [sum(column) // len(mine) for column in zip(*mine)]
    return [(i, k, d) for (i, x) in rows for d, k in [nearest(x)]], centres


def check(spark, rows, rule):
    found = centroids.cluster(frame(spark, rows), rule)
    want, centres = brute(rows, rule)

    def order(r):
        return (r[0] is None, r[0] or 0, r[1], r[2])

    assert sorted(map(tuple, found.rows.collect()), key=order) == sorted(want, key=order)
    assert found.centroids.tolist() == centres
    return found, want, centres


@pytest.mark.parametrize("block_columns", [1, 3, 5, 8])
def test_against_plain_rounds(spark, block_columns):
    rng = random.Random(block_columns)
    rows = [(k, [rng.gauss(3 * (k % 3), 1) for _ in range(5)]) for k in range(300)]
    rule = centroids.Lloyd(dimension=5, clusters=4, rounds=4, block_columns=block_columns, chunk_rows=16)
    found, want, centres = check(spark, rows, rule)
    report = centroids.cluster_report(found).collect()
    assert len(report) == 300
    for r in report:
        assert r.inertia == sum(d for _, _, d in want)
        assert r.cluster_inertia == sum(d for _, k, d in want if k == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_edge_cases(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(40)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [math.nan] * 3), (105, [math.inf, 0.0, 0.0])]
    rows += [(106, [1e30, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (7, rows[7][1]), (8, rows[9][1])]
    rows += [(200 + k, [0.25, 0.25, 0.25]) for k in range(60)]
    check(spark, rows, centroids.Lloyd(dimension=3, clusters=5, rounds=6, block_columns=2, chunk_rows=7))


def test_ties_and_empty_clusters(spark):
    """Equal first centroids: all vectors go to the first, the others stay where they are."""
    rows = [(k, [1.0, -1.0]) for k in range(20)] + [(50, [-2.0, 3.0])]
    rule = centroids.Lloyd(dimension=2, clusters=6, rounds=3, block_columns=1)
    check(spark, rows, rule)


def test_large_numbers_are_exact(spark):
    rng = random.Random(2)
    rule = centroids.Lloyd(dimension=4, clusters=3, rounds=3, block_columns=3, chunk_rows=8)
    rows = [(k, [rng.uniform(-1, 1) * rule.most / rule.scale for _ in range(4)]) for k in range(60)]
    check(spark, rows, rule)


def test_fewer_vectors_than_clusters_and_none(spark):
    rule = centroids.Lloyd(dimension=2, clusters=8, rounds=2)
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], rule)
    check(spark, [], rule)
    check(spark, [(None, [1.0, 2.0])], rule)
    assert centroids.cluster_report(centroids.cluster(frame(spark, []), rule)).collect() == []


def test_columns_are_dealt_once(spark):
    """A round moves distances and choices; the exchange of the columns is part of the kept table."""
    rule = centroids.Lloyd(dimension=2, clusters=2, rounds=1)
    seen = []
    join = type(spark.range(1)).join

    def spy(self, other, *args):
        out = join(self, other, *args)
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    try:
        type(spark.range(1)).join = spy
        centroids.cluster(frame(spark, [(k, [float(k), 1.0]) for k in range(10)]), rule)
    finally:
        type(spark.range(1)).join = join
    outside = [line for line in seen[0].split("InMemoryRelation")[0].splitlines() if "Exchange" in line]
    assert len(outside) == 0 and "ShuffledHashJoin" in seen[0]
