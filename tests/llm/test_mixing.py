import collections
import random

import brute
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing


def sizes_by_source(rows):
    total = collections.Counter()
    for _, text, _, source in rows:
        total[source] += len(brute.words_of(text))
    return total


def check(docs, rows, mix):
    plan = mixing.plan_mix(docs, mix)
    got = mixing.taken_words(plan).collect()
    totals = sizes_by_source(rows)
    wanted = brute.targets(totals, mix.weights, mix.share, mix.cap) if sum(totals.values()) else {}
    assert sorted((r.id is None, r.id or 0, r["size"]) for r in got) == sorted(
        (i is None, i or 0, len(brute.words_of(t))) for i, t, _, _ in rows
    )
    taken = collections.Counter()
    for r in got:
        assert r.source_size == totals[r.source]
        assert r.target == pytest.approx(wanted.get(r.source, 0.0))
        assert 0 <= r.taken <= mix.cap * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 0.5 for s in wanted)
    return plan, got


def test_edge_cases(edge):
    plan, got = check(edge, brute.edge_rows(), mixing.Mix(block=7))
    again = mixing.taken_words(mixing.plan_mix(edge, mixing.Mix(block=7))).collect()
    assert brute.plain_order(got) == brute.plain_order(again)
    # no block comes twice before all came once
    rounds = plan.slots.groupBy("sid", "block", "round").count()
    assert rounds.filter("count > 1").count() == 0
    counts = mixing.shard_counts(plan.slots)
    assert counts.agg(F.sum("slots")).first()[0] == plan.slots.count()
    places = mixing.place_slots(plan.slots, plan.mix).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in places.collect())


def test_empty_table(empty):
    assert mixing.taken_words(mixing.plan_mix(empty)).collect() == []
    assert mixing.mixed_texts(empty, mixing.plan_mix(empty)).count() == 0


def test_blank_table(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (2, " ", "en", None)]
    check(brute.frame(spark, rows), rows, mixing.Mix())


@pytest.mark.parametrize("block", [1, 16, 1000])
def test_many_sources(spark, block):
    rng = random.Random(block)
    rows = [(i, brute.prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "B", "é", "\U0001f600", "￿", None, ""] + ["hot"] * 6)) for i in range(200)]
    check(brute.frame(spark, rows), rows, mixing.Mix(block=block, shards=3))


def test_mixed_texts_are_the_taken_words(edge):
    mix = mixing.Mix(block=7)
    plan, got = check(edge, brute.edge_rows(), mix)
    out = mixing.mixed_texts(edge, plan)
    assert out.columns == edge.columns
    per_source = collections.Counter()
    for r in out.collect():
        per_source[r.source] += len(brute.words_of(r.text))
    wanted = collections.Counter()
    for r in got:
        wanted[r.source] += r.taken
    assert {s: n for s, n in per_source.items() if n} == {s: n for s, n in wanted.items() if n}


@pytest.mark.parametrize("key_bytes", [mixing._KEY_BYTES, 0])
def test_repeated_rows_take_their_own_words(spark, monkeypatch, key_bytes):
    """Rows alike in all, rows without id or source, and columns called like helpers."""
    monkeypatch.setattr(mixing, "_KEY_BYTES", key_bytes)
    rng = random.Random(2)
    base = [(i, brute.prose(rng, 9), "en", "a") for i in range(20)]
    rows = base + [(3, "same words of one text", "en", "a")] * 30 + [(None, "no id here", "en", None)] * 10 + base[:4]
    docs = brute.frame(spark, rows).withColumns({"_mix_id": F.lit(1), "_key": F.lit("k"), "_row": F.lit("r"), "_copy": F.lit(0)})
    plan = mixing.plan_mix(docs, mixing.Mix(block=7))
    out = mixing.mixed_texts(docs, plan)
    assert out.columns == docs.columns and out.filter("_key = 'k' AND _row = 'r' AND _copy = 0 AND _mix_id = 1").count() == out.count()
    wanted = plan.pieces.join(plan.docs.filter("size > 0"), ["sid", "start"]).groupBy("sid", "start", "id", "source", "round").agg(F.sum("words").alias("n"))
    assert brute.plain_order([(r.id, r.source, r.n) for r in wanted.collect()]) == brute.plain_order(
        [(r.doc_id, r.source, len(brute.words_of(r.text))) for r in out.collect()]
    )


def test_no_python_in_the_plan(edge):
    plan = mixing.mixed_texts(edge, mixing.plan_mix(edge))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
