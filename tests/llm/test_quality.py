import random

import brute

from sparkloom.llm import quality

SF = "/root/testdata/sf0.01"


def failed(m):
    return m[0] < 10 or 100 * m[4] > 20 * m[0]


def test_edge_cases(edge):
    rows = quality.judge(edge).collect()
    got = brute.plain_order((r.doc_id, *[r[c] for c in quality.MEASURES], r.base_failed) for r in rows)
    want = [(i, *brute.measures(t), failed(brute.measures(t))) for i, t, _, _ in brute.edge_rows()]
    assert got == brute.plain_order(want)
    assert not any(r.kept for r in rows if r.base_failed)


def test_empty_table(empty):
    assert quality.judge(empty).collect() == []
    assert quality.keep_good(empty).count() == 0


def test_repeats_of_all_shapes(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(150):
        words = [rng.choice("ab cd ef gh".split()) if rng.random() < 0.7 else brute.prose(rng, 1) for _ in range(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "\n", "\t\x0b"]).join(words) + rng.choice(["", "\n", "\n\nab\nab\n ab"]))
    docs = brute.frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: tuple(r[c] for c in quality.MEASURES) for r in quality.judge(docs).collect()}
    assert got == {i: brute.measures(t) for i, t in enumerate(texts)}


def test_estimation_agrees_with_plain_python(spark):
    """The same steps on the votes, one document at a time."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    measured, names = quality.measure(docs.select("text"))
    voted = measured.select(*quality.vote_columns(names=names)).cache()
    model = quality.fit(voted, rounds=2)
    rows = [tuple(r) for r in voted.collect()]
    prior = math.log(0.8 / 0.2)
    odds = [{1: 0.5, 0: 0.0, -1: -4.0} for _ in quality.RULES]
    for _ in range(2):
        good = [1 / (1 + math.exp(-(prior + sum(o[v] for o, v in zip(odds, r))))) for r in rows]
        ok, bad = sum(good), len(rows) - sum(good)
        prior = math.log((ok + 1) / (bad + 1))
        odds = [
            {
                v: math.log((sum(g for g, r in zip(good, rows) if r[j] == v) + 1) / (ok + 3))
                - math.log((sum(1 - g for g, r in zip(good, rows) if r[j] == v) + 1) / (bad + 3))
                for v in (1, 0, -1)
            }
            for j in range(len(odds))
        ]
    assert abs(model.prior - prior) < 1e-6
    for rule, by_vote in zip(quality.RULES, odds):
        assert all(abs(model.odds[rule.name][v] - by_vote[v]) < 1e-6 for v in by_vote)


def test_verdicts_match_labels(spark):
    """Labels are never seen by the method."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(docs).select("doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_stage_keeps_what_the_query_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache()
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    wanted = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted


def test_clashing_names(edge):
    assert quality.keep_good(edge).columns == edge.columns


def test_no_python_in_the_plan(edge):
    for df in (quality.judge(edge), quality.keep_good(edge)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_array_is_made_once(edge):
    """The optimizer may not repeat the costly steps wherever a measure is named."""
    plan = quality.keep_good(edge)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
