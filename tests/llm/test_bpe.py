import brute
import corpus_pipeline
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
with open(PATH, encoding="utf-8") as file:
    OURS = bpe.Vocabulary(file.read())


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text).tolist() == ids
    assert OURS.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    same(text)


def test_every_character_between_letters():
    """All assigned planes, in one text per block, so that character classes agree."""
    for start in range(0, 0x110000, 0x400):
        if not 0xD800 <= start < 0xE000:
            same("".join(f"a{chr(c)} {chr(c)}1" for c in range(start, start + 0x400)))


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "it's we'll 'S <|endoftext|>x<|endoftext|>", "<|endoftext", "a" * 50_000, " 　 \x85 \x1c x", "1" * 999])
def test_chosen_texts(text):
    same(text)


@given(st.lists(st.integers(0, 50300), max_size=20))
@settings(max_examples=200, deadline=None)
def test_any_ids_decode(ids):
    assert OURS.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_edge_cases(spark, edge):
    shared = bpe.read_vocabulary(spark, PATH)
    coded = bpe.encode(edge, shared)
    assert coded.columns == [c for c in edge.columns if c != "ids"] + ["ids"]
    rows = bpe.decode(coded, shared).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert r.ids == LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")


def test_empty_table(spark, empty):
    shared = bpe.read_vocabulary(spark, PATH)
    assert bpe.decode(bpe.encode(empty, shared), shared).count() == 0


def test_output_may_replace_the_text(spark, edge):
    shared = bpe.read_vocabulary(spark, PATH)
    once = bpe.encode(edge.select("doc_id", "text"), shared, ids="text")
    assert dict(once.dtypes)["text"] == "array<int>"


def test_brute_force_merging():
    """The queue gives what merging the lowest rank again and again gives."""
    for piece in ("thanonontioniner", "éèéèéè", "aaaaaaaaaaaaa", "Worcestershire"):
        symbols = [OURS.bytes[b] for b in piece.encode()]
        while True:
            ranked = [(OURS.merges[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in OURS.merges]
            if not ranked:
                break
            _, k = min(ranked)
            symbols[k : k + 2] = [OURS.merges[symbols[k], symbols[k + 1]][1]]
        assert OURS.merge(piece) == symbols


def test_a_worker_holds_only_what_it_needs():
    """Decoding builds no merges, encoding no strings."""
    with open(PATH, encoding="utf-8") as file:
        source = file.read()
    one, other = bpe.Vocabulary(source), bpe.Vocabulary(source)
    ids = other.encode("two words, two words").tolist()
    assert one.decode(ids) == "two words, two words"
    assert not {"merges", "ranks", "wholes"} & vars(one).keys()
    assert "strings" not in vars(other)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aehtionsr é'ñ", min_size=1, max_size=80), max_size=40))
def test_pieces_merged_together(pieces):
    """The rows of one set of queues give what a queue per piece gives."""
    assert [list(memoryview(ids).cast("i")) for ids in OURS.merge_all(pieces)] == [OURS.merge(p) for p in pieces]


def test_a_batch_meets_the_merges_at_once():
    """What is new in a batch is worked out in three calls (words, their ends, the rest), however many texts it has."""
    with open(PATH, encoding="utf-8") as file:
        ours = bpe.Vocabulary(file.read())
    calls, whole, spaced = [], ours.words.whole, ours.words.spaced
    ours.words.whole = lambda texts: calls.append(len(texts)) or whole(texts)
    ours.words.spaced = lambda words: calls.append(len(words)) or spaced(words)
    texts = [f"Word{k} of text,\n\nno {k}  and on \n" for k in range(200)]
    found = ours.encode_texts(texts)
    assert len(calls) == 3
    assert [f.tolist() for f in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_holds_one_worker_for_each_core(spark, edge, empty):
    """Encoding and decoding are one operator of Python; two in a row keep two workers for each core."""
    shared = bpe.read_vocabulary(spark, PATH)
    found = bpe.round_trip(edge.withColumn("ids", F.lit("old")), shared)
    assert found.columns == [c for c in edge.columns if c not in ("text", "ids", "decoded")] + ["ids", "decoded"]
    assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    want = bpe.decode(bpe.encode(edge, shared).drop("text"), shared)
    assert brute.plain_order(found.select("doc_id", "ids", "decoded").collect()) == brute.plain_order(want.select("doc_id", "ids", "decoded").collect())
    assert bpe.round_trip(empty, shared).count() == 0
    plan = corpus_pipeline.encode_texts(spark, edge, "")._jdf.queryExecution().executedPlan()
    assert str(plan).count("MapInArrow") == 1
