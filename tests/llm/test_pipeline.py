import brute
import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import quality
from sparkloom.session import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage, and what comes out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), name)
        seen.append(docs)
    return seen


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]
    for docs in steps[:-1]:
        assert docs.dtypes == steps[0].dtypes


def test_quality_drops_what_fails(steps):
    texts = {r.doc_id: r.text for r in steps[0].collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    for i, text in texts.items():
        m = brute.measures(text)
        if m[0] < 10 or 100 * m[4] > 20 * m[0]:
            assert i not in kept
    assert kept == {r.doc_id for r in quality.judge(steps[0]).filter("kept").collect()}


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    groups = brute.components(rows, 5, 80)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({c if n else i for i, n, c in groups})


def test_personal_data_is_gone(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    assert before.keys() == after.keys()
    changed = 0
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        changed += r.text != before[i]
        assert "@" not in before[i] or "<EMAIL>" in r.text or before[i] == r.text
    assert changed


def test_mix_has_the_targets(steps):
    size = {}
    for r in steps[3].collect():
        size[r.source] = size.get(r.source, 0) + len(brute.words_of(r.text))
    taken = {}
    for r in steps[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.words_of(r.text))
    wanted = brute.targets(size)
    assert all(abs(taken.get(s, 0) - wanted[s]) <= 0.5 for s in size)


def test_tokens_are_those_of_the_library(steps):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in steps[4].collect())
    assert sorted((r.doc_id, r.ids) for r in steps[5].collect()) == want


@pytest.mark.parametrize("place", range(5))
def test_edge_cases(spark, edge, empty, place):
    name, function = corpus_pipeline.STAGES[place]
    out = function(spark, edge, SF)
    if place < 4:
        assert out.columns == edge.columns
    out.collect()
    assert function(spark, empty, SF).count() == 0, name
