"""Mixing sources to target weights: blocks, multinomial shard counts, and index permutations.

The words of each source, in document order, are one stream cut into blocks of fixed length. A source
gets as many *slots* as its target asks for. Its slots fall on the output shards by one
multinomial draw, and slot ``k`` takes the block at place ``k`` of a pseudorandom permutation of the
source's blocks, one round of the permutation after the other; so no block comes twice before all came
once. Slots and blocks meet in a join by (source, permuted index), which no source makes uneven.

Everything is DataFrame code. Streams, permutations and places in a shard are orders over ranges, with one
carry row per range (``operators.ordering``); no source or shard is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.llm.common import WORD, require, word_count
from sparkloom.operators.ordering import running
from sparkloom.session import cut, stage

# Indexes that one row is expanded to at a time.
_SPAN = 4096


@dataclass(frozen=True)
class Mix:
    """Sources in code-point order, null last, weigh ``weights``, repeating; together they give
    ``share`` times all words, none more than ``cap`` times its own."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    block: int = 256
    shards: int = 16
    seed: int = 20


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, sid, source_size, target) from rows of (source, size).

    A target is ``min(cap * size, weight * level)`` with the one level at which all targets add up; that is
    where resharing what is over the caps, by weight, comes to rest. The windows run over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    weighed = (
        sources.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", F.get(weights, F.pmod("sid", F.lit(len(mix.weights))).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(mix.cap)))
    )
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(everything) * F.lit(float(mix.share))
    # over the rows the level rises to the one that fits and falls after it
    level = F.max("level").over(everything)
    return (
        weighed.withColumn("level", (wanted - capped) / open_weight)
        .withColumn("target", F.least("limit", F.col("weight") * level))
        .select("source", "sid", "source_size", "target")
    )


def _indexes(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """Each row once per index below ``count``, expanded in spans so that a large count is spread."""
    spans = rows.withColumn("_n", count).filter("_n > 0").withColumn(
        "_span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _SPAN)))
    )
    first = F.col("_span") * _SPAN
    return (
        spans.repartition("sid", "_span")
        .withColumn(name, F.explode(F.sequence(first, F.least(first + _SPAN, F.col("_n")) - 1)))
        .drop("_n", "_span")
    )


def permuted_blocks(sources: DataFrame, mix: Mix) -> DataFrame:
    """(sid, place, block, length, before): the blocks in permuted order, and the words before each."""
    blocks = _indexes(sources.select("sid", "source_size"), F.ceil(F.col("source_size") / mix.block), "block").select(
        "sid",
        "block",
        F.least(F.lit(mix.block).cast("long"), F.col("source_size") - F.col("block") * mix.block).alias("length"),
        F.xxhash64(F.lit(mix.seed), F.col("sid"), F.col("block")).alias("_order"),
    )
    ordered = running(blocks, ["sid"], ["_order", "block"], place=("count", "block"), upto=("sum", "length"))
    return ordered.select(
        "sid", (F.col("place") - 1).alias("place"), "block", "length", (F.col("upto") - F.col("length")).alias("before")
    )


def draw_slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """(sid, slot, shard, block, round, take): the slots, each with its block and how many words it takes.

    The last slots of a source are cut so that its words are its target, rounded.
    """
    blocks = F.ceil(F.col("source_size") / mix.block)
    need = F.round("target").cast("long")
    full = F.floor(need / F.greatest("source_size", F.lit(1)))
    rest = need - full * F.col("source_size")
    # one more than the rest fills, since a short block may come among the first
    last_round = F.least(blocks, F.ceil(rest / mix.block) + F.when(rest > 0, 1).otherwise(0))
    slots = _indexes(
        sources.select("sid", "source_size", need.alias("_need"), blocks.alias("_blocks"), (full * blocks + last_round).alias("_slots")),
        F.col("_slots"),
        "slot",
    ).select(
        "sid",
        "slot",
        "source_size",
        "_need",
        F.pmod(F.xxhash64(F.lit(mix.seed + 1), F.col("sid"), F.col("slot")), F.lit(mix.shards)).cast("int").alias("shard"),
        F.floor(F.col("slot") / F.col("_blocks")).cast("int").alias("round"),
        F.pmod("slot", F.col("_blocks")).alias("place"),
    )
    open_words = F.col("_need") - F.col("round") * F.col("source_size") - F.col("before")
    # what is expanded from a few rows looks small to the planner, and must not be broadcast
    return (
        slots.hint("merge").join(permuted_blocks(sources, mix).hint("merge"), ["sid", "place"])
        .withColumn("take", F.least("length", open_words))
        .filter("take > 0")
        .select("sid", "slot", "shard", "block", "round", "take")
    )


def shard_counts(slots: DataFrame) -> DataFrame:
    """The drawn counts: slots of every source in every shard."""
    return slots.groupBy("shard", "sid").agg(F.count("*").alias("slots"), F.sum("take").alias("words"))


def place_slots(slots: DataFrame, mix: Mix) -> DataFrame:
    """Slots with their place in their shard, in a pseudorandom order."""
    mixed = slots.withColumn("_order", F.xxhash64(F.lit(mix.seed + 2), F.col("sid"), F.col("slot")))
    placed = running(mixed, ["shard"], ["_order", "sid", "slot"], position=("count", "slot"))
    return placed.withColumn("position", F.col("position") - 1).drop("_order")


@dataclass(frozen=True)
class MixPlan:
    """``docs``: one row per document row (the id, source, size, source_size, target, sid, start, text_hash); ``slots``: see
    :func:`draw_slots`; ``pieces``: (sid, start, block, shard, slot, round, first, words), the words that each slot takes
    of each document, ``first`` counted from the document's start."""

    docs: DataFrame
    slots: DataFrame
    pieces: DataFrame
    mix: Mix


def plan_mix(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text: str = "text", source: str = "source") -> MixPlan:
    """Decide which words of every document the mix takes, and where they go.

    Defined results: null, empty and blank texts have no words and give none; a source without words has
    target 0; null is a source, the last. Rows that repeat an id, or are wholly equal, are documents of
    their own. Other columns are not read. An empty table gives an empty plan. Jobs run when this is called.
    """
    require(docs, id_col, text, source)
    sized = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "sizes",
    )
    sources = cut(source_targets(sized, mix))
    named = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    streams = running(named.drop("_source"), ["sid"], ["id", "text_hash", "size"], upto=("sum", "size"))
    placed = cut(streams.withColumn("start", F.col("upto") - F.col("size")).drop("upto"))
    slots = cut(draw_slots(sources, mix))
    spans = (
        placed.filter("size > 0")
        .select("sid", "start", "size")
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("start") / mix.block), F.floor((F.col("start") + F.col("size") - 1) / mix.block)
                )
            ),
        )
    )
    base = F.col("block") * mix.block
    low = F.greatest("start", base)
    high = F.least(F.col("start") + F.col("size"), base + F.col("take"))
    pieces = (
        spans.hint("merge").join(slots.hint("merge"), ["sid", "block"])
        .withColumn("words", high - low)
        .filter("words > 0")
        .select("sid", "start", "block", "shard", "slot", "round", (low - F.col("start")).alias("first"), "words")
    )
    return MixPlan(placed, slots, pieces, mix)


def taken_words(plan: MixPlan) -> DataFrame:
    """(id, source, size, source_size, target, taken) per document row."""
    taken = plan.pieces.groupBy("sid", F.col("start").alias("_key")).agg(F.sum("words").alias("taken"))
    # a document without words starts where another does, so it gets a key that nothing has
    key = F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    return (
        plan.docs.withColumn("_key", key)
        .join(taken.hint("merge"), ["sid", "_key"], "left")
        .select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


# Up to so many bytes of keys a broadcast finds the rows that are repeated; beyond it, a shuffle.
_KEY_BYTES = 32 << 20


def _keyed(rows: DataFrame, id_col: str, source: str, text_hash: Column) -> DataFrame:
    """``rows`` with the struct (id, source, text_hash) that wholly equal rows share as the column ``_key``."""
    return rows.withColumn("_key", F.struct(F.col(id_col).alias("id"), F.col(source).alias("source"), text_hash.alias("text_hash")))


def mixed_texts(
    docs: DataFrame, plan: MixPlan, id_col: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix as rows of ``docs``: a document once for each round that takes words of it, with the words taken.

    A text that a round takes whole stays as it is; of others the taken words are joined by one space.
    All other columns are those of the document.

    Texts cross once, to meet their ranges. Only rows that share id, source and text with another are numbered
    first, so that each of them takes the words of one place in the stream.

    Defined results: null, empty and blank texts are not in the mix; a null id or source is a value like others; of
    repeated rows each takes its own words, and which of them takes which is open; columns of any name
    stay as they are. An empty table gives no rows.
    """
    require(docs, id_col, text, source)
    own = docs.select(F.struct(*docs.columns).alias("_row"))
    keyed = _keyed(own, f"_row.{id_col}", f"_row.{source}", F.xxhash64(f"_row.{text}"))
    placed = _keyed(plan.docs.filter("size > 0"), "id", "source", F.col("text_hash")).select("sid", "start", "_key", "size")
    many = cut(placed.groupBy("_key").count().filter("count > 1").select("_key"))
    # equal rows are told apart by number, others have the number 1
    marked = placed.join(many.withColumn("_many", F.lit(True)), "_key", "left")
    same = Window.partitionBy("_key").orderBy("sid", "start")
    alike = marked.filter("_many").withColumn("_copy", F.row_number().over(same))
    numbered = marked.filter("_many IS NULL").withColumn("_copy", F.lit(1)).unionByName(alike)
    ranges = (
        plan.pieces.groupBy("sid", "start", "round")
        .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_ranges"), F.sum("words").alias("_taken"))
        .join(numbered.select("sid", "start", "_key", "_copy", F.col("size").alias("_size")), ["sid", "start"])
        .drop("sid", "start", "round")
    )
    # the side of the ranges is narrow, and has a row per key and round
    met = [keyed.join(ranges.filter("_copy = 1").hint("shuffle_hash"), "_key")]
    weight = many.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json("_key"))).alias("bytes")).first()
    if weight["n"]:
        few = F.broadcast(many) if weight["bytes"] <= _KEY_BYTES else many
        met = [keyed.join(few, "_key", "left_anti").join(ranges.filter("_copy = 1").hint("shuffle_hash"), "_key")]
        twins = Window.partitionBy("_key").orderBy(F.monotonically_increasing_id())
        repeated = keyed.join(few, "_key", "left_semi").withColumn("_copy", F.row_number().over(twins))
        met.append(repeated.join(ranges, ["_key", "_copy"]).select(*met[0].columns))
    whole = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    words = F.when(F.col("_taken") < F.col("_size"), F.regexp_extract_all(f"_row.{text}", F.lit(WORD), F.lit(0)))
    cut_up = whole.withColumn("_words", words)
    parts = F.transform("_ranges", lambda r: F.slice("_words", (r["first"] + 1).cast("int"), r["words"].cast("int")))
    chosen = F.when(F.col("_words").isNull(), F.col(f"_row.{text}")).otherwise(F.array_join(F.flatten(parts), " "))
    return cut_up.select(*[(chosen if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
