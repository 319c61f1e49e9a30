"""Token arrays: tokenising, labels, ranges, blocks, padding. Row-local expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from sparkloom.functions.text import WHITESPACE

# Sentinels of the data model.
IGNORE_LABEL = -100
PAD_TOKEN = 0
PAD_BLOCK = -1

END_OF_TEXT = "<|endoftext|>"
# template markers, then words, then single other characters
TOKEN_PATTERN = (
    r"<\|[a-z_]+\|>|[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_" + WHITESPACE + "]"
)


def split_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_id(token: Column) -> Column:
    """Id from the token alone (28 bits of md5), so that no vocabulary has to be joined."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int")


def tokenize(text: Column) -> Column:
    return F.transform(split_tokens(text), token_id)


def eos_id(marker: str = END_OF_TEXT) -> Column:
    """Constant folded by the optimizer."""
    return token_id(F.lit(marker))


def tokenizer_udf(load: Callable[[], Callable[[str], list[int]]]):
    """A caller's tokenizer as an Arrow UDF; ``load`` runs once per Python worker."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else run(t))

    return encode


def append_eos(ids: Column, eos: Column) -> Column:
    return F.when(F.try_element_at(ids, F.lit(-1)).eqNullSafe(eos), ids).otherwise(F.array_append(ids, eos))


def build_labels(ids: Column, user_len: Column, is_sft: bool = False) -> Column:
    """Copies of the ids; the user turn (SFT) or only the first place is ignored."""
    size = F.size(ids)
    masked = F.least(user_len if is_sft else F.lit(1), size)
    return F.concat(F.array_repeat(F.lit(IGNORE_LABEL), masked), F.slice(ids, masked + 1, size - masked))


def range_ids(user_len: Column, total_len: Column) -> Column:
    """Inclusive ranges of first token, context, question and answer, relative to the sample."""
    zero, user_end = F.lit(0), user_len - 1
    return F.array(zero, zero, zero, user_end, zero, user_end, user_len, total_len - 1)


def shift_labels(labels: Column) -> Column:
    """Rotate left by one over the whole pack; the last place is ignored."""
    moved = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.when(F.size(labels) == 0, labels).otherwise(F.array_append(moved, F.lit(IGNORE_LABEL)))


def drop_first_label(labels: Column) -> Column:
    """The other shift: labels without the first, to meet states without the last."""
    return F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))


def count_valid_labels(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE_LABEL))


def truncate_context(ids: Column, limit: int, other_len: Column) -> Column:
    """Cut the end of the context so that context and the rest stay within ``limit`` tokens."""
    return F.slice(ids, 1, F.greatest(F.lit(limit) - other_len, F.lit(0)))


def prompt_ids(ids: Column, num_prompt: Column) -> Column:
    return F.slice(ids, 1, num_prompt)


def completion_ids(ids: Column, num_prompt: Column) -> Column:
    return F.slice(ids, num_prompt + 1, F.greatest(F.size(ids) - num_prompt, F.lit(0)))


def block_count(length: Column, block: int) -> Column:
    return F.ceil(length / block).cast("int")


def token_blocks(ids: Column, block: int, full_only: bool = False) -> Column:
    """Consecutive blocks of ``block`` tokens; the last may be short unless ``full_only``."""
    n = F.floor(F.size(ids) / block).cast("int") if full_only else block_count(F.size(ids), block)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.slice(ids, i * block + 1, F.lit(block)))


def last_block_tokens(length: Column, block: int) -> Column:
    return length - (block_count(length, block) - 1) * block


def pad_to(values: Column, size: Column, pad: int) -> Column:
    missing = F.greatest(size - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(pad), missing))


def unpad(values: Column, length: Column) -> Column:
    return F.slice(values, 1, length)


def cut_completion(completion: Column, eos: Column, max_tokens: Column, ignore_eos: Column) -> Column:
    """Completion up to its first end token (kept), or to ``max_tokens`` tokens."""
    found = F.array_position(completion, eos).cast("int")
    stop = F.when(ignore_eos | (found == 0), F.size(completion)).otherwise(found)
    return F.slice(completion, 1, F.least(stop, max_tokens))


def cu_seqlens(lengths: Column) -> Column:
    """Offsets of consecutive pieces: 0, then the running total."""
    empty = F.array(F.lit(0)).cast("array<int>")
    return F.aggregate(lengths, empty, lambda acc, n: F.array_append(acc, (F.element_at(acc, -1) + n).cast("int")))


def chunked_parts(values: Column, parts: int, pad: int) -> Column:
    """Pad to a multiple of ``parts`` and cut into ``parts`` equal arrays."""
    missing = F.pmod(-F.size(values), F.lit(parts))
    full = F.concat(values, F.array_repeat(F.lit(pad), missing))
    step = ((F.size(values) + missing) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda r: F.slice(full, r * step + 1, step))
