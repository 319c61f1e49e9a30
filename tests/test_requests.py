import random

from sparkloom.operators import requests as rq


def test_prefix_reuse_against_a_plain_cache(spark):
    rng = random.Random(2)
    stem = [rng.randint(0, 3) for _ in range(40)]
    rows = []
    for i in range(200):
        if i % 3 == 0:  # a third of the requests share one text
            ids = list(stem)
        else:
            ids = stem[: rng.randint(0, 40)] + [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        rows.append((i, ids))
    frame = spark.createDataFrame(rows, "seq_id long, token_ids array<int>")
    got = {r.seq_id: r for r in rq.prefix_reuse(frame, 4).collect()}
    seen = set()
    for i, ids in rows:
        blocks = [tuple(ids[: (b + 1) * 4]) for b in range(len(ids) // 4)]
        cached = 0
        for b in blocks:
            if b not in seen:
                break
            cached += 1
        assert got[i].full_blocks == len(blocks)
        assert got[i].cached_blocks == cached and got[i].cached_tokens == cached * 4
        seen.update(blocks)
    assert got[0].cached_blocks == 0


def test_batches_cover_every_token_once(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 5, 20, 99, 100, 101, 250, 300])) for i in range(400)]
    frame = spark.createDataFrame(rows, "seq_id long, n int")
    got = rq.token_budget_batches(frame, 100, 6, chunks=7).toPandas()
    got["size"] = got.to_token - got.from_token
    per_request = got.sort_values("from_token").groupby("seq_id")
    assert {k: v.sum() for k, v in per_request["size"]} == dict(rows)
    per_batch = got.groupby("batch_no")
    assert per_batch["size"].sum().max() <= 100 and per_batch.size().max() <= 6
    assert sorted(got.batch_no.unique()) == list(range(got.batch_no.max() + 1))
    for _, batch in per_batch:
        cut = batch[(batch.to_token - batch.from_token < batch.seq_id.map(dict(rows)))]
        assert len(cut) <= 1 and (cut.empty or cut.seq_id.iloc[0] == batch.seq_id.min())


def test_few_shots_are_different(spark):
    items = spark.range(50).withColumnRenamed("id", "item_id")
    demos = spark.createDataFrame([(i, f"d{i}") for i in range(7)], "demo_id long, demo string")
    got = rq.few_shot_join(items, demos, shots=4, seed=1).collect()
    assert len(got) == 50 and all(len(set(r.demos)) == 4 for r in got)
    none = rq.few_shot_join(items, demos.limit(0), shots=4, seed=1).collect()
    assert len(none) == 50 and all(r.demos == [] for r in none)
    few = rq.few_shot_join(items, demos.limit(2), shots=4, seed=1).collect()
    assert all(len(set(r.demos)) == 2 for r in few)
