"""Hand-made items: cleaning, metadata, prompts, tokens, labels."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text, tokens
from sparkloom.operators import packing

BOM = "\ufeff"


def one(spark, value, expression, kind="string"):
    frame = spark.createDataFrame([(value,)], f"c {kind}")
    return frame.select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize("raw,want", [(None, ""), (BOM, ""), (f"a{BOM}b{BOM}", "ab"), ("x", "x")])
def test_clean(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


SPACES = " \t\n\v\f\r\x1c\x1f\x85\xa0\u1680\u2000\u2009\u2028\u202f\u3000"


def test_strip_is_unicode_aware(spark):
    padded = f"{SPACES}a b{SPACES}"
    assert one(spark, padded, text.rstrip) == padded.rstrip()
    assert one(spark, padded, text.lstrip) == padded.lstrip()
    assert one(spark, "\u200ba\u200b", text.rstrip) == "\u200ba\u200b"  # zero width is no space
    assert len(text.STRIP_CHARACTERS) == sum(chr(i).isspace() for i in range(0x110000))


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ("Other", True, None)),
        ("", ("Other", True, None)),
        ("{}", ("Other", True, None)),
        ("oops", ("Other", True, None)),
        ("[1, 2]", ("Other", True, None)),
        ("{'task': 'Code'}", ("Code", True, None)),
        ("{'task': 'Code', 'is_prefix': False, 'length': '12'}", ("Code", False, "12")),
        ("{'is_prefix': True, 'length': 12, 'x': None}", ("Other", True, "12")),
        ('{"task": "Say True, or: False", "is_prefix": None}', ("Say True, or: False", False, None)),
        ("{'task': 'Code', 'is_prefix': False,}", ("Code", False, None)),
        ("{'task': 'a, True, b'}", ("a, True, b", True, None)),
        ("{'is_prefix': 0.0, 'task': 'Code'}", ("Code", False, None)),
        ("{'is_prefix': [], 'task': 'Code'}", ("Code", False, None)),
        ("{'is_prefix': true, 'task': 'Code'}", ("Other", True, None)),
        ("{'task': 'it\\'s None', 'is_prefix': 2}", ("it's None", True, None)),
    ],
)
def test_metadata_text(spark, raw, want):
    frame = spark.createDataFrame([(raw,)], "m string")
    got = frame.select(text.parse_metadata(F.col("m"), frame.schema["m"].dataType).alias("p")).first().p
    assert tuple(got) == want


def test_metadata_struct(spark):
    kind = "struct<task string, is_prefix boolean, length string>"
    frame = spark.createDataFrame([(None,), (("Code", None, "3"),), ((None, True, None),)], f"m {kind}")
    got = frame.select(text.parse_metadata(F.col("m"), frame.schema["m"].dataType).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [("Other", True, None), ("Code", False, "3"), (None, True, None)]


@pytest.mark.parametrize("raw,want", [(None, 0), ("", 0), ("17", 17), ("12.7", 0), ("x", 0)])
def test_length(spark, raw, want):
    assert one(spark, raw, text.extract_length) == want


def test_prompt_order_and_wraps(spark):
    frame = spark.createDataFrame([("ctx \n", "  q?", True), ("ctx \n", "  q?", False)], "c string, q string, p boolean")
    got = [r[0] for r in frame.select(text.assemble_prompt(F.col("c"), F.col("q"), F.col("p"))).collect()]
    assert got == ["\nq?\n\nctx", "\nctx\n\nq?"]
    wrap = lambda task: one(spark, task, lambda c: text.task_prompt_wrap(F.lit("\nx"), c))
    assert wrap("Code") == text.CODE_LEAD + "\nx"
    assert wrap("Summarization") == text.SUMMARY_LEAD + "\nx\n\nSummary:"
    assert wrap("Single QA") == wrap("Other") == "\nx"


def test_chat_of_many_turns(spark):
    turns = [("system", "s"), ("user", "u"), ("assistant", "a"), ("user", "again")]
    frame = spark.createDataFrame([(turns,)], "m array<struct<role string, content string>>")
    got = frame.select(text.render_chat(F.col("m")), text.render_chat(F.col("m"), add_generation_prompt=True)).first()
    want = "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in turns)
    assert got[0] == want and got[1] == want + "<|im_start|>assistant\n"


def test_tokens_of_mixed_text(spark):
    raw = "<|im_start|>user\nÉtion, 12_a\u3000naïve é!<|im_end|>"
    got = one(spark, raw, tokens.split_tokens)
    assert got == ["<|im_start|>", "user", "Étion", ",", "12_a", "naïve", "é", "!", "<|im_end|>"]
    assert one(spark, "", tokens.tokenize) == []


def test_eos_and_labels(spark):
    ids = lambda v, f: one(spark, v, f, "array<int>")
    eos = F.lit(9)
    assert ids([], lambda c: tokens.append_eos(c, eos)) == [9]
    assert ids([1, 9], lambda c: tokens.append_eos(c, eos)) == [1, 9]
    assert ids([1, 2], lambda c: tokens.append_eos(c, eos)) == [1, 2, 9]
    assert ids([1, 2, 3], lambda c: tokens.build_labels(c, F.lit(2))) == [-100, 2, 3]
    assert ids([1, 2, 3], lambda c: tokens.build_labels(c, F.lit(2), True)) == [-100, -100, 3]
    assert ids([1, 2, 3], lambda c: tokens.build_labels(c, F.lit(3), True)) == [-100] * 3
    assert ids([-100, 2, 3], tokens.shift_labels) == [2, 3, -100]
    assert ids([], tokens.shift_labels) == []
    assert ids([-100, 2, -100], tokens.count_valid_labels) == 1


def test_blocks_and_parts(spark):
    ids = lambda v, f: one(spark, v, f, "array<int>")
    assert ids([1, 2, 3, 4, 5], lambda c: tokens.token_blocks(c, 2)) == [[1, 2], [3, 4], [5]]
    assert ids([1, 2, 3, 4, 5], lambda c: tokens.token_blocks(c, 2, full_only=True)) == [[1, 2], [3, 4]]
    assert ids([], lambda c: tokens.token_blocks(c, 2)) == []
    assert ids([1, 2, 3, 4, 5], lambda c: tokens.chunked_parts(c, 4, 0)) == [[1, 2], [3, 4], [5, 0], [0, 0]]
    assert ids([1, 2, 3, 4], lambda c: tokens.chunked_parts(c, 2, 0)) == [[1, 2], [3, 4]]
    assert ids([3, 4], tokens.cu_seqlens) == [0, 3, 7]


@pytest.mark.parametrize(
    "ids,most,ignore,want",
    [([5, 9, 6], 10, False, [5, 9]), ([5, 9, 6], 10, True, [5, 9, 6]), ([5, 6, 7], 2, False, [5, 6]), ([9], 5, False, [9]), ([], 5, False, [])],
)
def test_cut_completion(spark, ids, most, ignore, want):
    got = one(spark, ids, lambda c: tokens.cut_completion(c, F.lit(9), F.lit(most), F.lit(ignore)), "array<int>")
    assert got == want


def items(spark, rows):
    schema = "item_id long, context string, question string, answer string, metadata struct<task string, is_prefix boolean, length string>"
    return spark.createDataFrame(rows, schema)


def test_process_edges(spark):
    frame = items(
        spark,
        [
            (1, None, None, None, None),
            (2, f"{BOM}some context ", " a question", "an answer", ("Code", False, "5")),
            (3, "c", "q", "", ("Summarization", True, "")),
        ],
    )
    got = {r.item_id: r for r in packing.process_items(frame, packing.PackConfig()).collect()}
    sft = {r.item_id: r for r in packing.process_items(frame, packing.PackConfig(is_sft=True)).collect()}
    for r in got.values():
        assert r.labels[0] == -100 and r.labels[1:] == r.input_ids[1:]
        assert r.n == len(r.input_ids) and r.range_ids == [0, 0, 0, r.user_len - 1, 0, r.user_len - 1, r.user_len, r.n - 1]
        masked = sft[r.item_id].labels
        assert masked[: r.user_len] == [-100] * r.user_len and masked[r.user_len :] == r.input_ids[r.user_len :]
    assert (got[1].task_id, got[1].task_type) == (5, "Other")
    assert (got[2].task_id, got[3].task_id) == (3, 2)
    assert got[1].n == got[1].user_len + 1  # no answer: only the end token follows


def test_caller_tokenizer(spark):
    """A tokenizer object of the caller, loaded in the workers."""
    udf = tokens.tokenizer_udf(lambda: (lambda t: [ord(c) for c in t]))
    frame = items(spark, [(1, "c", "q", "a", ("Code", True, "1"))])
    config = packing.PackConfig(tokenizer=udf, eos=0)
    got = packing.process_items(frame, config).first()
    rendered = packing.prompts(frame).first()
    assert "".join(map(chr, got.input_ids[:-1])) == rendered.user_part + rendered.answer_part
    assert got.input_ids[-1] == 0 and got.user_len == len(rendered.user_part)
    without_end = packing.process_items(frame, packing.PackConfig(tokenizer=udf)).first()
    assert without_end.input_ids == got.input_ids[:-1]


def test_duration(spark):
    for seconds, want in [(0.0, "0:00:00"), (59.9, "0:00:59"), (3661.0, "1:01:01"), (360000.0, "100:00:00")]:
        assert one(spark, seconds, text.format_duration, "double") == want
