import collections
import random
import zlib

import brute
import pytest

from sparkloom.llm import sharding


def check(docs, rows, shards):
    got = sharding.kd_shards(docs, shards=shards).collect()
    expected = sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == expected
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return got, size


def test_edge_cases(edge):
    got, _ = check(edge, brute.edge_rows(), 4)
    again = sharding.kd_shards(edge, shards=4).collect()
    assert brute.plain_order(got) == brute.plain_order(again)


def test_empty_table(empty):
    assert sharding.kd_shards(empty, shards=8).collect() == []


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_bytes_are_near_equal_and_groups_together(spark, shards):
    rng = random.Random(shards)
    texts = [brute.prose(rng, rng.randint(1, 40)) for _ in range(400)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None]), rng.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(900)]
    got, size = check(brute.frame(spark, rows), rows, shards)
    largest = max(collections.Counter({t: 0 for t in texts} | collections.Counter(t for _, t, _, _ in rows)).values()) * 300
    assert max(size.values()) - min(size.values() if len(size) == shards else [0]) <= 3 * largest
    where = collections.defaultdict(set)
    text_of = {i: t for i, t, _, _ in rows}
    for r in got:
        where[text_of[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_that_outweighs_shards_is_dealt_out(spark):
    rng = random.Random(4)
    rows = [(i, "the same text " * 20 if i % 2 else brute.prose(rng, 30), "en", "a") for i in range(1200)]
    _, size = check(brute.frame(spark, rows), rows, 8)
    mean = sum(size.values()) / 8
    assert all(0.7 * mean < size[s] < 1.3 * mean for s in range(8))


def test_target_bytes(spark):
    rows = [(i, "x" * 99, "en", "a") for i in range(100)]
    got = sharding.kd_shards(brute.frame(spark, rows), target_bytes=1000).collect()
    assert len({r.shard for r in got}) <= 10
    with pytest.raises(ValueError):
        sharding.kd_shards(brute.frame(spark, rows))


def test_labels_that_begin_alike_are_split(spark):
    """Sources of equal weight with one long prefix, and nothing else to split by."""
    names = ["common_crawl_" + "x" * 20 + end for end in ("a", "b", "c", "d")]
    rows = [(7, f"{i:06d}", "en", names[i % 4]) for i in range(400)]
    docs = brute.frame(spark, rows)
    source_of = {zlib.crc32(t.encode()): s for _, t, _, s in rows}
    got = sharding.kd_shards(docs, shards=4).collect()
    shards = collections.defaultdict(set)
    for r in got:
        shards[source_of[r.text_crc32]].add(r.shard)
    assert sorted(len(s) for s in shards.values()) == [1, 1, 1, 1] and len(set.union(*shards.values())) == 4


def test_many_leaves(spark):
    rows = [(i, f"{i * 7919 % 3001:05d}", "en", f"s{i % 50}") for i in range(3000)]
    _, size = check(brute.frame(spark, rows), rows, 500)
    assert len(size) == 500 and max(size.values()) <= 2 * min(size.values())


def test_no_python_in_the_plan(edge):
    plan = sharding.kd_shards(edge, shards=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
