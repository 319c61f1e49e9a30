import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ordering as o


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # a third of all rows share one length
    data = [(i, rng.choice([7, 7, rng.randint(0, 50), rng.randint(0, 50)]), rng.choice([None, rng.random()])) for i in range(1000)]
    return data, spark.createDataFrame(data, "item_id long, length int, v double")


def test_index_and_shards(rows):
    data, frame = rows
    got = o.contiguous_shards(frame, "length", "item_id", shards=7, chunks=6).toPandas().sort_values("idx")
    want = [r[0] for r in sorted(data, key=lambda r: (r[1], r[0]))]
    assert got.item_id.tolist() == want
    assert got.idx.tolist() == list(range(1000))
    sizes = got.groupby("shard").size().tolist()
    assert sizes == [143] * 6 + [142]
    assert got.shard.is_monotonic_increasing


def test_fewer_rows_than_shards(spark):
    frame = spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "item_id long, length int")
    got = o.contiguous_shards(frame, "length", "item_id", shards=32).toPandas()
    assert sorted(got.shard.tolist()) == [0, 1, 2]


def test_empty(spark):
    frame = spark.createDataFrame([], "item_id long, length int")
    assert o.contiguous_shards(frame, "length", "item_id").count() == 0


def test_replicas_are_disjoint_and_even(rows):
    _, frame = rows
    got = o.replica_shards(frame, "item_id", world=14, sequence_parallel=2, seed=1, chunks=5).toPandas()
    assert got.groupby("replica").size().tolist() == [142] * 7
    assert got.item_id.is_unique
    again = o.replica_shards(frame, "item_id", world=14, sequence_parallel=2, seed=1, chunks=3).toPandas()
    assert sorted(zip(got.item_id, got.replica)) == sorted(zip(again.item_id, again.replica))
    other = o.replica_shards(frame, "item_id", world=14, sequence_parallel=2, seed=2).toPandas()
    assert sorted(zip(got.item_id, got.replica)) != sorted(zip(other.item_id, other.replica))


@pytest.mark.parametrize("n,world", [(10, 4), (3, 8), (8, 4), (1, 5)])
def test_eval_replicas_repeat_from_the_start(spark, n, world):
    got = o.replica_shards_eval(spark.range(n), "id", world=world).toPandas().sort_values("eval_idx")
    total = -(-n // world) * world
    assert got.eval_idx.tolist() == list(range(total))
    assert got.id.tolist() == [i % n for i in range(total)]
    assert got.is_padding.tolist() == [i >= n for i in range(total)]


def test_running_over_chunks(rows):
    data, frame = rows
    got = (
        o.running(
            frame.withColumn("k", F.when(F.col("item_id") % 10 == 0, "b").otherwise("a")),
            ["k"], ["length", "item_id"], chunks=9,
            total=("sum", "v"), n=("count", "v"), known=("last", "v"), before=("prev", "item_id"), start=("first", "item_id"),
        )
        .toPandas()
        .astype(object)
    )
    got = got.where(got.notna(), None)
    for k in ("a", "b"):
        mine = sorted((r for r in data if (r[0] % 10 == 0) == (k == "b")), key=lambda r: (r[1], r[0]))
        part = got[got.k == k].sort_values(["length", "item_id"])
        total, n, known, before = None, 0, None, None
        for want, row in zip(mine, part.itertuples()):
            if want[2] is not None:
                total, n, known = (total or 0) + want[2], n + 1, want[2]
            assert row.item_id == want[0] and row.n == n and row.known == known
            assert (row.total is None) == (total is None) and (total is None or abs(row.total - total) < 1e-9)
            assert row.before == before and row.start == mine[0][0]
            before = want[0]


def test_resume():
    assert o.consumed_samples(5, 4, 8, 2) == 320
    assert o.consumed_samples(5, 4, 8, 2, replication=3) == 106
    assert o.accumulation_steps(48, 1, 8, 1) == 6
