"""Hashes of words: no pattern of letters makes two words meet."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import jaccard, substrings, words


def hashes(texts, lower=False):
    out = [None] * len(texts)
    for first, _, found, counts in words.word_slices(pa.array(texts, pa.string()), lower):
        ends = np.cumsum(counts)
        for k, n in enumerate(counts.tolist()):
            out[first + k] = found[ends[k] - n : ends[k]].tolist()
    return out


def thue_morse(n, letters):
    """The word of n letters whose k-th letter tells whether k has an odd number of one bits."""
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 1 << 15])
def test_complementary_words_differ(n):
    (a,), (b,) = hashes([thue_morse(n, "ab"), thue_morse(n, "ba")])
    assert a != b


def test_equal_words_are_equal_wherever_they_stand():
    long = "x" * 3000
    texts = [f"a {long} b", long, None, "", f" \n{long}\t", f"{'y ' * 600_000}{long}", "A B"]
    found = hashes(texts)
    assert found[0][1] == found[1][0] == found[4][0] == found[5][-1]
    assert found[2] == found[3] == []
    assert hashes(["A B"], lower=True) == hashes(["a b"])


def test_words_of_few_letters_are_told_apart():
    texts = [" ".join("".join("ab"[(k >> j) & 1] for j in range(14)) for k in range(1 << 14)), "a b aa ab ba bb aé éa"]
    for found in hashes(texts):
        assert len(set(found)) == len(found)


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_keep_them_apart(spark, n):
    one, two = thue_morse(n, "ab"), thue_morse(n, "ba")
    shared = [f"w{k}" for k in range(12)]
    rows = [
        (1, one, "en", "a"),
        (2, two, "en", "a"),
        (3, " ".join([*shared, one]), "en", "a"),
        (4, " ".join([*shared, two]), "en", "a"),
    ]
    docs = brute.frame(spark, rows)
    found = jaccard.near_duplicates(docs, jaccard.Similarity(words=4, percent=85)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 3, 4: 4}
    removed = substrings.remove_repeats(docs, window=13)
    assert {r.doc_id: r.n_removed for r in removed.collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
