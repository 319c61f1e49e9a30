import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import token_files, token_queries
from sparkloom.session import stage_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, rows):
    """(doc_id, length, checksum) in order, ids last, and their starts."""
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def stored(spark, docs, layout=token_files.Layout()):
    folder = stage_path(spark, "tokens")
    token_files.store_texts(docs, token_files.read_tokenizer(spark, PATH), 2, folder, layout)
    found = token_files.read_token_files(spark, folder)
    return folder, found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()


def check(got, want):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.crc) for r in got) == sorted(
        (i is None, i or 0, n, c) for i, n, c in want
    )
    # starts are gapless, in the order of ids, nulls last
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [i for i, _, _ in want]
    place = 0
    for r in order:
        assert r.start == place
        place += r.n_tokens


def test_edge_cases(spark, edge, tokenizer):
    want = expected(tokenizer, [(i, t) for i, t, _, _ in brute.edge_rows()])
    _, got = stored(spark, edge)
    check(got, want)
    _, again = stored(spark, edge.repartition(5))
    assert brute.plain_order(got) == brute.plain_order(again)


def test_small_blocks_and_files(spark, edge, tokenizer):
    folder, got = stored(spark, edge, token_files.Layout(block_ids=50, file_blocks=2))
    check(got, expected(tokenizer, [(i, t) for i, t, _, _ in brute.edge_rows()]))
    assert spark.read.format("binaryFile").load(f"{folder}/data").count() > 4


def test_empty_table(spark, empty):
    assert stored(spark, empty)[1] == []


def test_hot_id_is_spread(spark, tokenizer):
    rows = [(7 if k % 3 else k, f"word {k} " * (k % 5)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    _, got = stored(spark, docs)
    check(got, expected(tokenizer, rows))
    ids = token_files.tokenize_texts(docs, token_files.read_tokenizer(spark, PATH), 2)
    layout = token_files.Layout()
    folder = stage_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(ids, folder, layout)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.ids for r in spark.read.parquet(f"{folder}/parts").collect()]
    assert len(sizes) == 8 and max(sizes) < sum(sizes) / 3


def test_ranks_and_size(spark, edge):
    """The most frequent id has rank 0, and files are smaller than 32-bit ids by more than half."""
    ids = token_files.tokenize_texts(edge, token_files.read_tokenizer(spark, PATH), 2).cache()
    folder = stage_path(spark, "tokens")
    token_files.write_token_files(ids, folder)
    flat = np.concatenate([token_files.held_ids(r.ids) for r in ids.filter("ids IS NOT NULL").collect()])
    values, counts = np.unique(flat, return_counts=True)
    want = values[np.lexsort((values, -counts))]
    assert [r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()] == want.tolist()
    held = spark.read.format("binaryFile").load(f"{folder}/data").agg(F.sum("length")).first()[0]
    assert held < 2 * len(flat)


def test_words_are_cut_where_the_library_cuts_them(tokenizer):
    encoder = token_files.Encoder(open(PATH, encoding="utf-8").read())
    assert encoder.by_words
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "'s", "don't", "12", "3.5", "\u4e2d\u6587", "<|endoftext|>", "\U0001f600"]
    parts += ["\u0301", "\u200b", "\ufeff", "x" * 100, "Word", ".", "...", "\r\n", "<|endof", "text|>"]
    texts = ["", " ", "   ", "a  b", "a   b", "\n  a", "a \n b", "a\n b", " a", "a "]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    encoder.KNOWN = 3
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder.encode([t])] == want


def test_another_kind_of_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.Encoder(open(path, encoding="utf-8").read())
    assert not encoder.by_words
    texts = ["Two  Words", "", "a\nb"]
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_vocabulary_bound_is_an_error(spark, edge):
    ids = token_files.tokenize_texts(edge, token_files.read_tokenizer(spark, PATH))
    with pytest.raises(ValueError):
        token_files.rank_ids(ids, token_files.Layout(max_vocabulary=10))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    rng = np.random.RandomState(n)
    ranks = (rng.randint(0, 1 << 32, n, dtype=np.uint64) >> rng.randint(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
    assert (token_files.unpack(control, data, n) == ranks).all()


def test_file_that_is_none():
    with pytest.raises(ValueError):
        list(token_files.read_blocks(b"x" * 100))


def test_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = token_queries.op12_token_files(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 4
    check([r for r in got.withColumnRenamed("ids_crc32", "crc").collect()], expected(tokenizer, [tuple(r) for r in docs]))


def test_marks_do_not_make_new_words(tokenizer):
    """A word with marks or a line end costs no encoding of its own once its parts are known, and frequent words stay."""
    encoder = token_files.Encoder(open(PATH, encoding="utf-8").read())
    asked = []
    spaced = encoder.words.spaced
    encoder.words.spaced = lambda words: asked.extend(words) or spaced(words)
    texts = ["a Wort, Wort. Wort;\n\nWort Wort\nWort (Wort) été, été.\nété don't Wort's <|endoftext|>Wort Wort<|endoftext|>"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert asked.count("Wort") == 1 and asked.count("été") == 1 and not {"Wort,", "Wort.", "Wort\nWort", "été,"} & set(asked)
    encoder.KNOWN = 1
    for _ in range(5):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert asked.count("Wort") == 1


def test_words_go_to_the_model_unless_they_hold_a_special_token():
    """New words of Latin letters are no text for the library to take apart; one that holds a special token is."""
    library = Tokenizer.from_file(PATH)
    library.add_special_tokens(["PAD"])
    encoder = token_files.Encoder(library.to_str())
    texts = [f"first thention{k} éonai aPADb PAD niñez 中文 ﬁn ǅon" for k in range(20)] + ["a of thonre and anblewh"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    sent, ids = [], encoder.library_ids
    encoder.library_ids = encoder.words.whole = lambda some: sent.extend(some) or ids(some)
    assert [np.frombuffer(found, "<u4").tolist() for found in encoder.encode(texts)] == want
    assert not any("thonre" in s or "niñez" in s for s in sent)


def test_words_are_rows_of_arrays(tokenizer):
    """Words are told apart by all their bytes, also by zero bytes and at the ends of a key; a word of the table takes few bytes."""
    encoder = token_files.Encoder(open(PATH, encoding="utf-8").read())
    words = [c * n + end for c in ("a", "é", "\0", "中") for n in range(1, 27) for end in ("", "\0", "b", ".", "\n")]
    rng = random.Random(5)
    words += ["".join(rng.choice("aeiourstnéß") for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for known in (encoder.KNOWN, 2000):
        encoder.KNOWN = known
        assert [np.frombuffer(x, "<u4").tolist() for k in range(0, 300, 30) for x in encoder.encode(texts[k : k + 30])] == want
    encoder.encode(["a"])
    table = encoder.words.known
    assert 0 < table.n <= 2 * 2000 + 9000
    rng = random.Random(6)
    encoder.encode([" ".join("".join(rng.choice("aeiourstn") for _ in range(9)) for _ in range(60_000))])
    held = sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray))
    assert table.n > 60_000 and held < 130 * table.n


def test_marks_and_words_are_entries_of_their_own(tokenizer):
    """Words with marks are not kept beside their parts, so the table grows with words and marks and not with pairs of them."""
    encoder = token_files.Encoder(open(PATH, encoding="utf-8").read())
    words = [f"{a}{b}té" for a in "bcdfghjklm" for b in ("an", "én", "or", "ub", "yl")]
    marks = [".", ",", ";", "!!", "$$$", ".\n", ",&&&", ")", "-", "'s", "12", "\n\n"]
    texts = [" ".join(w + m + v for w in words for v in ("", "Le", "x")) for m in marks]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert encoder.words.known.n < 2 * (len(words) + 3 * len(marks))


def test_parts_keep_their_ids_between_white_space_and_special_tokens():
    """White space before a word, a special token or the end of a text is taken apart as the library does."""
    library = Tokenizer.from_file(PATH)
    library.add_special_tokens(["PAD", "é|", "\n\n\n"])
    encoder = token_files.Encoder(library.to_str())
    assert encoder.by_words
    rng = random.Random(7)
    space = [" ", " ", "  ", "\n", "\n", "\t", "\x1c", "\x85", " ", " ", " ", "　", "​"]
    parts = space + ["a", "é", "×", "ɏ", "ɐ", "слово", "中", "́", "’", "'", "'s", ".", "1", "PAD", "é|", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for k in range(0, 4000, 100) for x in encoder.encode(texts[k : k + 100])] == want
