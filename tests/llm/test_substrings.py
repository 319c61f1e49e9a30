import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import substrings
from sparkloom.llm.words import word_slices


def cut(docs, window=13):
    return brute.plain_order(substrings.remove_repeats(docs, window).collect())


def test_edge_cases(edge):
    rows = [r[:2] for r in brute.edge_rows()]
    assert cut(edge) == brute.plain_order(brute.without_repeats(rows, 13))


def test_empty_table(empty):
    assert cut(empty) == []


@pytest.mark.parametrize("window", [7, 13, 20])
def test_shared_passages(spark, window):
    rng = random.Random(window)
    vocabulary = [brute.prose(rng, 1) for _ in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 50))] for _ in range(15)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))]
        rows.append((rng.randint(0, 100), " ".join(text)))
    docs = brute.frame(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5)
    assert cut(docs, window) == brute.plain_order(brute.without_repeats(rows, window))


def test_a_window_has_room_for_its_anchor(empty):
    with pytest.raises(ValueError):
        substrings.remove_repeats(empty, window=2 * substrings.REACH)


def test_equal_windows_point_at_equal_anchors():
    rng = random.Random(1)
    passage = [brute.prose(rng, 1) for _ in range(40)]
    texts = [" ".join([brute.prose(rng, rng.randint(1, 9)), *passage, brute.prose(rng, 5)]) for _ in range(5)]
    keys = []
    for text in texts:
        ((_, _, hashes, counts),) = word_slices(pa.array([text]))
        at = len(text.split()) - 5 - len(passage)
        starts, anchors = substrings._anchors(hashes, np.zeros(counts[0], int), 13)
        keys.append(anchors[(starts >= at) & (starts <= at + len(passage) - 13)].tolist())
    assert all(k == keys[0] for k in keys)


def test_words_hash_alike_wherever_they_stand():
    texts = ["one two\tthree", "", None, "three two one", "x" * 3_000_000 + " one " + "y " * 700_000, "one"]
    seen, counts_of = {}, []
    for first, last, hashes, counts in word_slices(pa.array(texts)):
        at = 0
        for row, n in zip(range(first, last), counts):
            for word, value in zip((texts[row] or "").split(), hashes[at : at + n].tolist()):
                assert seen.setdefault(word, value) == value
            counts_of.append(int(n))
            at += n
    assert counts_of == [len((t or "").split()) for t in texts]
    assert len(set(seen.values())) == len(seen)
