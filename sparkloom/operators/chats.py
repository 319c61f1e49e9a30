"""Chats of whole conversations, however long: turns in order, joined by running offsets.

A turn's place in its chat is the length of all turns before it, a running sum over ordered chunks, so no conversation is
gathered to be sorted. The text is then cut into parts of a fixed number of characters: a part holds the pieces of the turns
that fall into it, and is bounded whatever the conversation or a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.functions.text import ChatTemplate
from sparkloom.operators.ordering import running

PART_CHARS = 1 << 20


def chat_turns(
    turns: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    chunks: int | None = None,
) -> DataFrame:
    """(conversation, turn, role, start, stop, rendered): every turn as the template writes it, and its characters in the chat.

    Turns are ordered by number, then role and a hash of the text. A null text is empty, a null role is written as nothing. Rows without
    a conversation are one conversation of their own.
    """
    head, named, tail = template.prefix.partition("{role}")
    who = F.coalesce(role, F.lit("")) if named else F.lit("")
    said = F.concat(F.lit(head), who, F.lit(tail), F.coalesce(content, F.lit("")), F.lit(template.suffix))
    rows = turns.select(conversation, turn, role, said.alias("rendered"))
    rows = rows.withColumns({"_mark": F.xxhash64("rendered"), "_chars": F.length("rendered")})
    placed = running(rows, [conversation], [turn, role, "_mark"], chunks=chunks, stop=("sum", "_chars"))
    return placed.select(conversation, turn, role, (F.col("stop") - F.col("_chars")).alias("start"), "stop", "rendered")


def chat_parts(
    placed: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = False,
    part_chars: int = PART_CHARS,
    conversation: str = "conv_id",
) -> DataFrame:
    """(conversation, part, text) of the turns of :func:`chat_turns`: ``part_chars`` characters each, the last one of a chat fewer.

    A chat of at most ``part_chars`` is one row. The generation prompt follows the last turn. Turns without characters add nothing.
    """
    pieces = placed.select(conversation, "start", "stop", "rendered")
    if add_generation_prompt:
        # one row per conversation, of a fixed text
        ends = pieces.groupBy(conversation).agg(F.max("stop").alias("start"))
        opening = F.lit(template.generation)
        pieces = pieces.unionByName(
            ends.select(conversation, "start", (F.col("start") + F.length(opening)).alias("stop"), opening.alias("rendered"))
        )
    first, last = F.floor(F.col("start") / part_chars), F.floor((F.col("stop") - 1) / part_chars)
    cut = pieces.filter("stop > start").withColumn("part", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("part") * part_chars)
    end = F.least(F.col("stop"), (F.col("part") + 1) * part_chars)
    text = F.substring("rendered", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))
    found = cut.select(conversation, "part", F.struct(begin.alias("at"), text.alias("text")).alias("piece"))
    joined = found.groupBy(conversation, "part").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return joined.select(conversation, "part", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))
