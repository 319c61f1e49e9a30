import math


import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from sparkloom.llm import neighbours

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("q", T.StringType()), T.StructField("cell", T.StringType())]
)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], SCHEMA)


def brute_force(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if usable(i, v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted((-float((v * w).sum()), j) for j, w in good if j != i and len(w) == len(v))[:k]
    return {i: best for i, best in out.items() if best}


def usable(i, v):
    return i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def searched(docs, search):
    rows = neighbours.nearest_neighbours(docs, F.col("vec_id") % 20 == 0, search).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((-r.score, r.vec_id))
    return out


def test_edge_cases(spark):
    rng = np.random.RandomState(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(None, [1.0] * 6), (100, None), (120, [0.0] * 6), (140, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (160, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0])]
    rows += [(180, [1.0, float("inf"), 1.0, 1.0, 1.0, 1.0]), (200, [1.0, 2.0]), (220, []), (7, rows[7][1]), (40, rows[40][1]), (300, rows[5][1])]
    got = searched(frame(spark, rows), neighbours.Search(k=20))
    want = brute_force(rows, 20)
    assert got.keys() == want.keys()
    for i, best in want.items():
        assert [j for _, j in got[i]] == [j for _, j in best]
        assert [s for s, _ in got[i]] == pytest.approx([s for s, _ in best])


def test_empty_table_and_few_rows(spark):
    assert searched(frame(spark, []), neighbours.Search()) == {}
    assert searched(frame(spark, [(0, [1.0, 2.0])]), neighbours.Search()) == {}
    assert searched(frame(spark, [(0, [1.0, 2.0]), (1, [3.0, 1.0])]), neighbours.Search()) == {0: [(-5.0, 1)]}


def test_lengths_are_searched_apart(spark):
    rng = np.random.RandomState(8)
    rows = [(i, rng.standard_normal(3 + i % 3).tolist()) for i in range(300)]
    got, want = searched(frame(spark, rows), neighbours.Search(k=5, confidence=0.999)), brute_force(rows, 5)
    assert got.keys() == want.keys() and len(got) == 15
    assert sum([j for _, j in got[i]] == [j for _, j in best] for i, best in want.items()) >= 14


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(100)]
    got = searched(frame(spark, rows), neighbours.Search(k=5, cell_rows=10))
    assert [j for _, j in got[40]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("vector", [[1.0, 1.0, 1.0], np.random.RandomState(5).standard_normal(64).astype(np.float32).tolist()])
def test_copies_of_the_largest_vector(spark, vector):
    """The 20th best score is the query's own squared norm: nothing may be lost to rounding, in any cell or part."""
    rng = np.random.RandomState(11)
    rows = [(i, vector) for i in range(100)]
    rows += [(100 + i, (0.1 * rng.standard_normal(len(vector))).tolist()) for i in range(200)]
    for cell_rows in (4096, 15):
        got = searched(frame(spark, rows), neighbours.Search(k=20, cell_rows=cell_rows))
        for query in range(0, 100, 20):
            assert [j for _, j in got[query]] == [j for j in range(100) if j != query][:20]
        assert all(len(best) == 20 for best in got.values()) and len(got) == 15


def test_reach_covers_copies_of_any_vector():
    for vector in np.random.RandomState(6).standard_normal((500, 64)).astype(np.float32).astype(float):
        square = sum(x * x for x in vector.tolist())
        worst = float(neighbours.inner(vector[None], vector)[0])
        assert neighbours.reach(square**0.5, vector @ vector, worst, neighbours.Search().quantile()) > 0


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_recall_over_many_cells(spark, scale):
    """Clustered vectors, of one norm and of many, in small cells and parts."""
    rng = np.random.RandomState(7)
    centres = rng.standard_normal((12, 24))
    vectors = centres[rng.randint(12, size=3000)] + 0.6 * rng.standard_normal((3000, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) ** (1 - scale)
    rows = list(enumerate(vectors.tolist()))
    got = searched(frame(spark, rows), neighbours.Search(k=20, cell_rows=100))
    want = brute_force(rows, 20)
    hits = sum(len({j for _, j in got[i]} & {j for _, j in best}) for i, best in want.items())
    assert hits >= 0.95 * 20 * len(want)


def test_quantile():
    # fixed values: tables of the chi-squared law
    for directions, confidence, value in ((16, 0.95, 26.296), (10, 0.99, 23.209), (6, 0.5, 5.348)):
        assert neighbours.Search(directions=directions, confidence=confidence).quantile() == pytest.approx(value, rel=0.01)


def test_tree_cells_lie_in_their_boxes():
    points = np.random.RandomState(3).standard_normal((500, 4))
    points[:200] = points[0]
    tree = neighbours.grow(points, 16)
    cells = tree.cells(points)
    for point, cell in zip(points, cells):
        assert tree.distances(point)[cell] == 0

