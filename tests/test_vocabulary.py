"""A vocabulary that grows: stable dense ids, exact round trips, one exchange of the tokens."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import vocabulary as vb

SCHEMA = "doc_id long, tokens array<string>, id string, token string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(3)


def words(seed, count, size):
    rng = random.Random(seed)
    return [(k, [f"w{rng.randint(0, size)}" for _ in range(rng.randint(0, 40))]) for k in range(count)]


def table(spark, path, version=None):
    return {r.token: r.id for r in vb.read_vocabulary(spark, path, version).collect()}


def test_ids_never_change(spark, tmp_path):
    path = str(tmp_path / "v")
    assert vb.versions(spark, path) == 0 and vb.read_vocabulary(spark, path).collect() == []
    first = frame(spark, words(1, 50, 100))
    assert vb.append_tokens(first, path) == 1
    one = table(spark, path)
    assert sorted(one.values()) == list(range(len(one))) and sorted(one) == sorted(one, key=one.get)
    assert vb.append_tokens(first, path) == 1  # nothing new
    assert vb.append_tokens(frame(spark, words(2, 50, 200)), path) == 2
    two = table(spark, path)
    assert all(two[t] == k for t, k in one.items()) and len(two) > len(one)
    assert sorted(two.values()) == list(range(len(two)))
    assert table(spark, path, 1) == one


def test_a_version_that_is_not_whole_is_not_read(spark, tmp_path):
    path = str(tmp_path / "v")
    vb.append_tokens(frame(spark, [(1, ["a", "b"])]), path)
    (tmp_path / "v" / "version=2").mkdir()
    assert vb.versions(spark, path) == 1 and table(spark, path) == {"a": 0, "b": 1}


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 20])
def test_round_trip(spark, tmp_path, block_bytes):
    rows = words(3, 200, 300) + [(900, []), (901, None), (902, ["w1", None, "w1"]), (None, ["é", "", " "]), (5, ["w1"] * 2000), (5, ["w1"] * 2000)]
    docs = frame(spark, rows)
    path = str(tmp_path / "v")
    vb.append_tokens(docs, path)
    known = vb.read_vocabulary(spark, path)
    encoded = vb.encode(docs, known, block_bytes=block_bytes)
    ids = table(spark, path)

    def order(r):
        return (r[0] is None, r[0] or 0, repr(r[1]))

    want = sorted(((k, None if t is None else [ids.get(x) for x in t]) for k, t in rows), key=order)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=order) == want
    back = vb.decode(encoded.drop("id", "token"), known, block_bytes=block_bytes)
    assert sorted(((r.doc_id, r.tokens) for r in back.collect()), key=order) == sorted(rows, key=order)


def test_unknown_tokens_and_ids_are_null(spark, tmp_path):
    path = str(tmp_path / "v")
    vb.append_tokens(frame(spark, [(1, ["a", "b"])]), path)
    known = vb.read_vocabulary(spark, path)
    assert vb.encode(frame(spark, [(1, ["a", "c"])]), known).first().ids == [0, None]
    assert vb.decode(spark.createDataFrame([(1, [1, 7])], "doc_id long, ids array<long>"), known).first().tokens == ["b", None]
    assert vb.encode(frame(spark, []), known).collect() == []


def test_a_large_vocabulary_is_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    rows, path = words(6, 40, 60), str(tmp_path / "v")
    docs = frame(spark, rows)
    vb.append_tokens(docs, path)
    monkeypatch.setattr(vb, "BROADCAST_BYTES", 0)
    known = vb.read_vocabulary(spark, path)
    back = vb.decode(vb.encode(docs, known).drop("id", "token"), known)
    assert sorted((r.doc_id, r.tokens) for r in back.collect()) == sorted(rows)


def test_tokens_cross_one_exchange(spark, tmp_path):
    path = str(tmp_path / "v")
    docs = frame(spark, words(4, 20, 30))
    vb.append_tokens(docs, path)
    plan = vb.encode(docs, vb.read_vocabulary(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Generate" in plan
    physical = vb.encode(docs, vb.read_vocabulary(spark, path))._jdf.queryExecution().executedPlan().toString()
    # the rows of a block: an exchange by block over the staged table; all other exchanges carry single tokens
    wide = [line for line in physical.splitlines() if "Exchange hashpartitioning(_block" in line]
    assert 1 <= len(wide) <= 2


def test_hot_block_is_split(spark):
    """Rows with one key, a third of all, are dealt to several blocks."""
    rows = frame(spark, [(1 if k % 3 else k, ["w"] * 50) for k in range(600)])
    schema = "doc_id long, tokens array<string>, id string, token string, _block long"
    blocked = rows.mapInArrow(vb._blocked(1, [*rows.columns, "_block"], 2000), schema)
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("n")).collect()
    assert len(sizes) > 10 and max(r.n for r in sizes) < 100


def test_rows_hold_numbers_of_entries(spark):
    """What is staged and exchanged of a row are numbers; each distinct token of a block stands there once."""
    rows = frame(spark, [(k, ["w", "v", None, f"t{k // 10}"]) for k in range(100)] + [(100, None), (101, [])])
    names = [*rows.columns, "_block", "_entries"]
    number, code = vb._blocked(1, names[:-1], 400), vb._coded(1, names, pa.string())
    schema = "doc_id long, tokens array<int>, id string, token string, _block long, _entries array<string>"
    out = rows.mapInArrow(lambda batches: code(number(batches)), schema).collect()
    entries = {r._block: r._entries for r in out if r._entries is not None}
    assert len(entries) > 3 and all(len(set(e)) == len(e) for e in entries.values())
    back = {r.doc_id: r.tokens and [None if c is None else entries[r._block][c] for c in r.tokens] for r in out if r._entries is None}
    assert back == {r.doc_id: r.tokens for r in rows.collect()}


def test_a_large_vocabulary_takes_one_join(spark, tmp_path, monkeypatch):
    """A block has an entry once, so that entries are joined as they are, without a count of their keys."""
    path, docs = str(tmp_path / "v"), frame(spark, words(5, 20, 30))
    vb.append_tokens(docs, path)
    monkeypatch.setattr(vb, "BROADCAST_BYTES", 0)
    plan = vb.encode(docs, vb.read_vocabulary(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
