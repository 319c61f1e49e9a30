import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import jaccard
from sparkloom.llm.graph import connected_components

RULES = [jaccard.Similarity(4, 85), jaccard.Similarity(5, 80)]


def chain(rng, length, steps):
    """Texts each a few words off the one before."""
    text = brute.prose(rng, length).split()
    out = []
    for _ in range(steps):
        text = list(text)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = brute.prose(rng, 1)
        out.append(" ".join(text))
    return out


def found(docs, rule):
    rows = jaccard.near_duplicates(docs, rule).select("doc_id", "n_shingles", "component_id").collect()
    return brute.plain_order(rows)


@pytest.mark.parametrize("rule", RULES)
def test_edge_cases(edge, rule):
    rows = [r[:2] for r in brute.edge_rows()]
    assert found(edge, rule) == brute.plain_order(brute.components(rows, rule.words, rule.percent))


def test_empty_table(empty):
    assert found(empty, RULES[0]) == []
    assert jaccard.keep_one_per_group(empty).count() == 0


@pytest.mark.parametrize("page_load", [jaccard.PAGE_LOAD, 4000])
def test_chains_of_copies(spark, monkeypatch, page_load):
    """Groups that hang together by links only, in one page and over many."""
    monkeypatch.setattr(jaccard, "PAGE_LOAD", page_load)
    rng = random.Random(3)
    texts = chain(rng, 60, 80) + chain(rng, 150, 60) + chain(rng, 12, 40) + [brute.prose(rng, rng.randint(1, 9)) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = brute.frame(spark, [(i, t, "en", "a") for i, t in rows])
    assert found(docs, RULES[0]) == brute.plain_order(brute.components(rows, 4, 85))


def test_members_meet_their_texts_by_a_shuffle(spark, monkeypatch):
    plans, whole = {}, jaccard.stage

    def noted(df, name, path=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, name, path)

    monkeypatch.setattr(jaccard, "stage", noted)
    rows = [(i, "one and the same words of a text " + "abc"[i % 3], "en", "a") for i in range(30)]
    found(brute.frame(spark, rows), RULES[0])
    assert "ShuffledHashJoin" in plans["points"] and "Broadcast" not in plans["points"]


def test_short_texts_at_the_threshold(spark):
    words = [f"w{k}" for k in range(30)]
    rows = [(n, " ".join(words[:n])) for n in range(1, 30)]
    docs = brute.frame(spark, [(i, t, "en", "a") for i, t in rows])
    for rule in RULES:
        assert found(docs, rule) == brute.plain_order(brute.components(rows, rule.words, rule.percent))


def test_intervals_allow_for_every_difference():
    for rule in RULES:
        intervals = rule.intervals(5000)
        for low, high, blocks, spare in intervals:
            sizes = range(2, 2 * high + 1)
            assert max(s - 2 * rule.overlap(s) for s in sizes) < blocks - spare
        assert [a[1] + 1 for a in intervals[:-1]] == [b[0] for b in intervals[1:]]


def test_one_of_each_group_stays(edge):
    rows = [r[:2] for r in brute.edge_rows()]
    kept = jaccard.keep_one_per_group(edge, RULES[1])
    assert kept.columns == edge.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect()))
    groups = brute.components(rows, 5, 80)
    with_words = {c for (i, n, c), (_, t) in zip(groups, rows) if i is not None and n}
    alone = [i for (i, n, _) in groups if i is None or not n]
    assert got == sorted((i is None, i or 0) for i in [*with_words, *alone])


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(1000, 1200)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5} | {k: 5 for k in range(1000, 1200)}


def test_long_texts_that_share_a_passage_are_no_family(spark):
    """Their counts tell them apart, so that long texts do not hang together and are never compared in pages."""
    draw = random.Random(5)
    shared = " ".join(f"p{draw.randrange(10**6)}" for _ in range(300))
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(4000)) + " " + shared for _ in range(12)]
    texts.append(texts[0].replace("w", "w", 1) + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = jaccard.Similarity(words=5, percent=80)
    sets = jaccard.text_sets(docs, rule)
    points = sets.select("set_hash", "n", "counts")
    families = jaccard._families(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), points, rule)
    hashes = {r._id: r.set_hash for r in sets.collect()}
    assert {r.node for r in families.collect()} == {hashes[0], hashes[12]}


def test_folded_points_bound_the_overlap():
    """Whatever the sizes, the bound is never below the true overlap."""
    draw = np.random.RandomState(3)
    for n, m, common in ((1500, 1600, 1450), (5000, 6100, 4900), (3000, 3100, 10), (60_000, 70_000, 60_000), (900_000, 1_000_000, 890_000)):
        every = np.unique(draw.randint(0, 1 << 62, n + m, dtype=np.uint64))
        one, other = every[:n], every[n - common : n - common + m]
        x, y = jaccard._counts(one, np.array([len(one)]))[0], jaccard._counts(other, np.array([len(other)]))[0]
        groups = min(len(x), len(y))
        bound = jaccard._bounds(jaccard._folded(y, groups)[None, :], jaccard._folded(x, groups))[0]
        assert bound >= len(np.intersect1d(one, other))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_cells_of_two_become_pairs(size):
    """Whatever the batches, a cell of two is a pair, and a larger one keeps its rows."""
    draw = random.Random(size)
    rows = sorted({(c, draw.randrange(50)) for c in range(40) for _ in range(draw.choice([2, 2, 2, 3, 9]))})
    of: dict = {}
    for c, s in rows:
        of.setdefault(c, []).append(s)
    rows = [(c, s) for c, s in rows if len(of[c]) > 1]
    batches = [
        pa.record_batch(
            [pa.array([c for c, _ in part], pa.int64()), pa.array([0] * len(part), pa.int32()), pa.array([s for _, s in part], pa.int64())],
            names=["cell", "block", "set_hash"],
        )
        for part in (rows[k : k + size] for k in range(0, len(rows), size))
    ]
    out = [r for b in jaccard._pairs_apart(iter(batches)) for r in b.to_pylist()]
    assert {(r["set_hash"], r["other"]) for r in out if r["other"] is not None} == {tuple(v) for v in of.values() if len(v) == 2}
    assert [(r["cell"], r["set_hash"]) for r in out if r["other"] is None] == [(c, s) for c, s in rows if len(of[c]) > 2]


def test_one_python_worker_for_each_core(edge, monkeypatch):
    """No two operators of Python stand in one stage, where each holds a worker of its own for every core."""
    plans, whole = {}, jaccard.stage

    def noted(df, name, path=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, name, path)

    monkeypatch.setattr(jaccard, "stage", noted)
    assert found(edge, RULES[1])
    assert plans["cells"].count("MapInArrow") == 2 and "Exchange" in plans["cells"]
    assert all(plan.count("MapInArrow") <= 1 + plan.count("Exchange") for plan in plans.values())
