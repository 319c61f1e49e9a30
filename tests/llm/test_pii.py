import random
import re

import brute
import pytest

from sparkloom.llm import em, pii

BASE = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def plain(text):
    return [[m.span() for m in re.finditer(p, text) if ok(m[0])] for p, ok in BASE]


def test_base_rules_on_random_text():
    rng = random.Random(8)
    pieces = ["@", ".", "a.b", "x@y.z", "a@b@c.d", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "-", "12", "é", "com", "..", "0", "٣", "+49.30", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1 " * 50_000, "+1" + " " * 100_000])
def test_long_runs_take_linear_time(text):
    pii.candidates(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_edge_cases(edge):
    found = pii.find_spans(edge, pii.fit(edge))
    rows = found.collect()
    assert len(rows) == edge.count()
    assert "text" not in found.columns and found.columns[-1] == "spans"
    assert all(r.spans == [] for r in rows if r.doc_id in (4, 5, 6))
    assert pii.redact_texts(edge, pii.fit(edge)).columns == edge.columns


def test_empty_table(empty):
    model = pii.fit(empty)
    assert pii.find_spans(empty, model).collect() == []
    assert pii.redact_texts(empty, model).count() == 0


def corpus(rng, n):
    """Texts with planted spans beyond the base rules, and with look-alikes."""
    rows, planted = [], []
    for i in range(n):
        text, spans = brute.prose(rng, 30) + " ", []
        kind = i % 6
        digits = "".join(rng.choice("23456789") for _ in range(10))
        if kind == 0:
            spans.append((len(text), f"{brute.prose(rng, 1)} (at) {brute.prose(rng, 1)} (dot) org"))
            text += f"{spans[-1][1]} "
        elif kind == 1:
            text += "phone: "
            spans.append((len(text), f"({digits[:3]}) {digits[3:6]}-{digits[6:]}"))
            text += spans[-1][1] + " "
        elif kind == 2:
            text += f"write to x{i}@example.com or +1 {digits} "
        elif kind == 3:
            text += f"order {digits}{digits[:5]}7 "
        elif kind == 4:
            text += f"version {i}.999.1.2 "
        rows.append((i, text + brute.prose(rng, 10), "en", "a"))
        planted.append({(a, a + len(s)) for a, s in spans})
    return rows, planted


def test_added_spans_on_held_out_texts(spark):
    rng = random.Random(6)
    train, _ = corpus(rng, 600)
    held, planted = corpus(rng, 300)
    model = pii.fit(brute.frame(spark, train))
    right = wrong = missed = 0
    for (_, text, _, _), spans in zip(held, planted):
        added = {(c.start, c.end) for c in model.spans(text) if not c.base}
        right, wrong, missed = right + len(added & spans), wrong + len(added - spans), missed + len(spans - added)
    assert right >= 0.9 * (right + missed)
    assert wrong <= 0.05 * (right + wrong)


def test_base_spans_stay_and_are_listed_in_order(spark):
    text = "call +1 (743) 555-3824 or mail a.b@c.de, 1.2.3.4, 4111 1111 1111 1111, x@y.org"
    docs = brute.frame(spark, [(1, text, "en", "a")])
    row = pii.find_spans(docs, pii.fit(docs)).select("spans", pii.span_list(base_only=True).alias("s")).first()
    want = ",".join(f"{k}:{a}:{b}" for k, own in zip(pii.BASE_KINDS, plain(text)) for a, b in own)
    assert row.s == want


def test_redaction():
    spans = [pii.Candidate(0, 3, 6, True, ()), pii.Candidate(3, 5, 9, True, ()), pii.Candidate(1, 10, 11, True, ())]
    assert pii.redact("abcdefghijk", spans) == "abc<EMAIL>j<IP>"


def test_estimation_finds_the_true_rates():
    rng = random.Random(3)
    accuracy = [0.95, 0.8, 0.7]
    counts, true_share = {}, {}
    for _ in range(20_000):
        true = rng.random() < 0.4
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == true else -1) for a in accuracy)
        counts[(0, *votes)] = counts.get((0, *votes), 0) + 1
        true_share[(0, *votes)] = true_share.get((0, *votes), 0) + true
    soft = em.posteriors(counts, 1, 3)
    weights = em.train(soft, counts, 1)
    for p, n in counts.items():
        if n > 300:
            assert abs(soft[p] - true_share[p] / n) < 0.1
            assert abs(em.score(weights, p, 1) - soft[p]) < 0.15
    assert em.posteriors({}, 1, 3) == {}
