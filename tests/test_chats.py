"""Chats of whole conversations against plain Python."""

import collections
import random

import pytest

from sparkloom.functions.text import ChatTemplate
from sparkloom.operators import chats

SCHEMA = "conv_id long, turn int, role string, text string, start string, part string"


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], "é" * rng.randint(0, 30) + f" {conv}.{turn}"))
    rows += [(50, k, "user", f"hot {k} " * 3) for k in range(150)]  # most of all rows
    rows += [(60, 0, None, None), (60, 1, "user", ""), (None, 0, "user", "x"), (None, 1, "user", "y"), (61, 0, "user", "z" * 500)]
    return rows


def plain(rows, template, opening):
    head, tail = template.prefix.split("{role}")
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append((turn, f"{head}{role or ''}{tail}{text or ''}{template.suffix}"))
    return {conv: "".join(t for _, t in sorted(turns)) + (template.generation if opening else "") for conv, turns in said.items()}


@pytest.mark.parametrize("part_chars", [7, 100, 1 << 20])
@pytest.mark.parametrize("opening", [False, True])
def test_parts(spark, part_chars, opening):
    template = ChatTemplate() if part_chars != 100 else ChatTemplate("[{role}] ", "\n", "[assistant] ")
    rows = conversations()
    frame = spark.createDataFrame([(*r, "s", "p") for r in rows], SCHEMA).repartition(5)
    placed = chats.chat_turns(frame, template)
    got = chats.chat_parts(placed, template, opening, part_chars).collect()
    want = {
        (conv, k): text[k * part_chars : (k + 1) * part_chars]
        for conv, text in plain(rows, template, opening).items()
        for k in range(-(-len(text) // part_chars))
    }
    assert {(r.conv_id, r.part): r.text for r in got} == want and len(got) == len(want)
    whole = plain(rows, template, False)
    for r in placed.collect():
        assert whole[r.conv_id][r.start : r.stop] == r.rendered


def test_repeated_turns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "", "")] * 2, SCHEMA)
    assert [r.text for r in chats.chat_parts(chats.chat_turns(frame)).collect()] == ["<|im_start|>user\na<|im_end|>\n" * 2]
    assert chats.chat_parts(chats.chat_turns(frame.filter("false")), add_generation_prompt=True).collect() == []


def test_a_template_that_writes_nothing(spark):
    frame = spark.createDataFrame([(1, 0, "user", "", "", ""), (1, 1, None, "b", "", "")], SCHEMA)
    template = ChatTemplate("", "", "")
    assert [(r.part, r.text) for r in chats.chat_parts(chats.chat_turns(frame, template), template, True).collect()] == [(0, "b")]
