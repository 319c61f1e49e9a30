"""From raw items to packed training rows, and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.functions import text, tokens
from sparkloom.operators.greedy import Budget, cut_chunks, greedy_cuts
from sparkloom.operators.ordering import index_chunks, ordered_chunks, shard_of, with_global_index
from sparkloom.session import stage


@dataclass(frozen=True)
class PackConfig:
    max_len: int = 128 * 1024
    min_len: int = 1000
    shards: int = 32
    is_sft: bool = False
    template: text.ChatTemplate = field(default_factory=text.ChatTemplate)
    # text -> ids as an Arrow UDF; None uses the SQL tokenizer
    tokenizer: Callable[[Column], Column] | None = None
    # end token; None is that of the SQL tokenizer, or no end token for a caller's tokenizer
    eos: int | None = None

    def with_end(self, ids: Column) -> Column:
        if self.eos is not None:
            return tokens.append_eos(ids, F.lit(self.eos))
        return ids if self.tokenizer is not None else tokens.append_eos(ids, tokens.eos_id())


def with_length(items: DataFrame) -> DataFrame:
    """Use the ``length`` column, or take it from the metadata."""
    if "length" in items.columns:
        return items
    meta = text.parse_metadata(F.col("metadata"), items.schema["metadata"].dataType)
    return items.withColumn("length", text.extract_length(meta["length"]))


def prompts(items: DataFrame, template: text.ChatTemplate = text.ChatTemplate()) -> DataFrame:
    """Rendered user and answer parts of each item."""
    meta = text.parse_metadata(F.col("metadata"), items.schema["metadata"].dataType)
    cleaned = items.select(
        "item_id",
        *[text.clean_text(F.col(c)).alias(c) for c in ("context", "question", "answer")],
        meta.alias("meta"),
    )
    user = text.task_prompt_wrap(
        text.assemble_prompt(F.col("context"), F.col("question"), F.col("meta.is_prefix")), F.col("meta.task")
    )
    return cleaned.select(
        "item_id",
        F.col("meta.task").alias("task_type"),
        text.render_message("user", user, template).alias("user_part"),
        F.when(F.col("answer") != "", text.render_message("assistant", F.col("answer"), template))
        .otherwise("")
        .alias("answer_part"),
    )


def process_items(items: DataFrame, config: PackConfig) -> DataFrame:
    """Tokens, labels, class and ranges of each item."""
    rendered = prompts(items, config.template)
    if config.tokenizer is None:
        # the SQL tokenizer never joins characters across a template marker
        ids = rendered.withColumn("_user", tokens.tokenize(F.col("user_part"))).withColumn(
            "_ids", F.concat("_user", tokens.tokenize(F.col("answer_part")))
        )
    else:
        ids = rendered.withColumn("_user", config.tokenizer(F.col("user_part"))).withColumn(
            "_ids", config.tokenizer(F.concat("user_part", "answer_part"))
        )
    ended = ids.select(
        "item_id", "task_type", F.size("_user").alias("user_len"),
        config.with_end(F.col("_ids")).alias("input_ids"),
    )
    return ended.select(
        "item_id",
        "input_ids",
        tokens.build_labels(F.col("input_ids"), F.col("user_len"), config.is_sft).alias("labels"),
        text.task_class_id(F.col("task_type")).alias("task_id"),
        "task_type",
        tokens.range_ids(F.col("user_len"), F.size("input_ids")).alias("range_ids"),
        F.size("input_ids").alias("n"),
        "user_len",
    )


def length_bounds(df: DataFrame, low: int, high: int, n: str = "n") -> DataFrame:
    """Keep sizes within both bounds, ends included."""
    return df.filter(F.col(n).between(low, high))


def pack_next_fit(
    sizes: DataFrame, max_len: int, shard: str = "shard", order: str = "idx", n: str = "n", chunks: int | None = None
) -> DataFrame:
    """Pack number of each row: a row that does not fit closes the pack of its shard.

    Reads only narrow columns; tokens never enter the fold.
    """
    return _pack_numbers(greedy_cuts(sizes, shard, [order], Budget(max_len, column=n), chunks=chunks))


def _pack_numbers(cuts: DataFrame) -> DataFrame:
    return cuts.withColumn("pack_no", F.col("_cut").cast("int")).drop("_cut", "_starts")


def finalize_pack(samples: DataFrame, *keys: str, order: str = "idx", is_sft: bool = False) -> DataFrame:
    """One row per pack: tokens and labels joined in order, offsets, class and range lists.

    Labels and ranges follow from the tokens and the length of the user turn, so they
    are made here and never shuffled. A pack holds at most the configured number of
    tokens, so its row is bounded.
    """
    fields = ("input_ids", "user_len", "task_id", "task_type")
    packed = samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("s"))
    return join_items(packed, *keys, is_sft=is_sft)


def join_items(packed: DataFrame, *keys: str, is_sft: bool = False) -> DataFrame:
    """:func:`finalize_pack` of rows that hold their samples, in order, in the array ``s``."""

    def each(make: Callable[[Column], Column]) -> Column:
        return F.transform("s", lambda x: make(x))

    return packed.select(
        *keys,
        F.flatten(each(lambda x: x["input_ids"])).alias("input_ids"),
        F.flatten(each(lambda x: tokens.build_labels(x["input_ids"], x["user_len"], is_sft))).alias("labels"),
        tokens.cu_seqlens(each(lambda x: F.size(x["input_ids"]))).alias("seq_lengths"),
        each(lambda x: x["task_id"]).alias("task_ids"),
        each(lambda x: x["task_type"]).alias("task_type"),
        each(lambda x: tokens.range_ids(x["user_len"], F.size(x["input_ids"]))).alias("range_ids"),
    )


def unpack(packs: DataFrame, *keys: str) -> DataFrame:
    """Packs back to samples: lengths are the differences of the offsets."""
    last = F.size("seq_lengths") - 1
    exploded = packs.select("*", F.posexplode(F.slice("seq_lengths", F.lit(1), last)).alias("ord", "start"))
    length = F.get("seq_lengths", F.col("ord") + 1) - F.col("start")
    return exploded.select(
        *keys,
        "ord",
        length.alias("n"),
        F.slice("input_ids", F.col("start") + 1, length).alias("input_ids"),
        F.slice("labels", F.col("start") + 1, length).alias("labels"),
        F.get("task_ids", F.col("ord")).alias("task_id"),
        F.get("task_type", F.col("ord")).alias("task_type"),
        F.get("range_ids", F.col("ord")).alias("range_ids"),
    )


def sp_split(packs: DataFrame, ways: int) -> DataFrame:
    """Shift labels, pad, and cut every pack in equal parts; offsets stay those of the whole pack."""
    parts = packs.select(
        "*",
        F.posexplode(
            F.arrays_zip(
                tokens.chunked_parts(F.col("input_ids"), ways, tokens.PAD_TOKEN).alias("ids"),
                tokens.chunked_parts(
                    tokens.shift_labels(F.col("labels")), ways, tokens.IGNORE_LABEL
                ).alias("shifted"),
            )
        ).alias("sp_rank", "part"),
    )
    kept = [c for c in packs.columns if c not in ("input_ids", "labels")]
    return parts.select(
        *kept, "sp_rank", F.col("part.ids").alias("input_ids"), F.col("part.shifted").alias("shifted_labels")
    )


def assign_packs(items: DataFrame, samples: DataFrame, config: PackConfig, chunks: int | None = None) -> DataFrame:
    """(item_id, shard, idx, n, pack_no) of every kept sample.

    Shards are cut over all items by raw length, before the token-count filter.
    """
    sizes = with_length(items).select("item_id", "length").join(samples.select("item_id", "n"), "item_id", "left")
    # the order by length is also the order of shards and of places in them: one sort serves both
    indexed = index_chunks(ordered_chunks(sizes, "length", "item_id", chunks=chunks))
    placed = indexed.filter(F.col("n").isNotNull()).select(
        shard_of(F.col("idx"), F.col("total"), config.shards).alias("shard"), "idx", "item_id", "n", "_chunk", "_row"
    )
    return _pack_numbers(cut_chunks(placed, "shard", Budget(config.max_len)))


def staged_samples(items: DataFrame, config: PackConfig) -> DataFrame:
    """Tokenise once and write; later passes read only the columns they need.

    What follows from the tokens and the user turn is not written. The bounds apply to the written table: put before the write, the optimizer would
    move the filter below the tokenizer and run it twice.
    """
    samples = process_items(items, config).drop("labels", "range_ids")
    return length_bounds(stage(samples, "samples"), config.min_len, config.max_len)


def build_packed_dataset(items: DataFrame, config: PackConfig, chunks: int | None = None) -> DataFrame:
    """Packed training rows, keyed by (shard, pack_no)."""
    samples = staged_samples(items, config)
    places = assign_packs(items, samples, config, chunks).select("item_id", "shard", "idx", "pack_no")
    return finalize_pack(samples.join(places, "item_id"), "shard", "pack_no", is_sft=config.is_sft)


def pack_summary(assigned: DataFrame) -> DataFrame:
    """How many packs and how full, per shard."""
    packs = assigned.groupBy("shard", "pack_no").agg(F.sum("n").alias("used"), F.count("*").alias("items"))
    return packs.groupBy("shard").agg(
        F.count("*").alias("packs"),
        F.sum("items").alias("items"),
        F.sum("used").alias("tokens"),
        F.min("used").alias("min_used"),
        F.max("used").alias("max_used"),
    )


def union_chunks(*packs: DataFrame) -> DataFrame:
    """Bag union of packs made apart."""
    out = packs[0]
    for more in packs[1:]:
        out = out.unionByName(more)
    return out


def zip_params(prompts_df: DataFrame, params: DataFrame, key: str = "seq_id", default: dict | None = None) -> DataFrame:
    """Pair of every prompt with the params of its key.

    A prompt without params takes ``default``; where there is none, that is an error, and no prompt is lost.
    """
    mark = params.withColumn("_paired", F.lit(True))
    names = [c for c in params.columns if c != key]
    missing = F.raise_error(F.lit("a prompt has no params"))

    def chosen(name: str) -> Column:
        kind = params.schema[name].dataType
        other = missing if default is None else F.lit(default[name])
        return F.when(F.col("_paired"), F.col(name)).otherwise(other.cast(kind)).alias(name)

    joined = prompts_df.join(mark, key, "left")
    return joined.select(*prompts_df.columns, *[chosen(n) for n in names])


def zip_by_position(
    prompts_df: DataFrame, params: DataFrame, order: str, params_order: str, chunks: int | None = None
) -> DataFrame:
    """Pair of the n-th prompt with the n-th params; different numbers of both are an error."""
    names = [c for c in params.columns if c != params_order]
    left = with_global_index(prompts_df, order, name="_place", total="_prompts", chunks=chunks)
    right = with_global_index(params, params_order, name="_place", total="_params", chunks=chunks)
    unequal = F.raise_error(F.lit("prompts and params differ in number"))
    same = F.col("_prompts").eqNullSafe(F.col("_params"))
    paired = left.join(right.select("_place", "_params", *names), "_place", "left")
    return paired.select(
        *prompts_df.columns,
        *[F.when(same, F.col(n)).otherwise(unequal.cast(params.schema[n].dataType)).alias(n) for n in names],
    )


def one_param_for_all(prompts_df: DataFrame, **values) -> DataFrame:
    """A single params value applies to every prompt."""
    return prompts_df.withColumns({k: F.lit(v) for k, v in values.items()})


PARAM_TYPES = T.StructType(
    [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("ignore_eos", T.BooleanType()),
    ]
)


def checked_params(df: DataFrame) -> DataFrame:
    """Temperature must be above 1e-10; greedy drawing is not offered."""
    return df.withColumn(
        "temperature",
        F.when(F.col("temperature") > 1e-10, F.col("temperature")).otherwise(
            F.raise_error(F.lit("temperature must be above 1e-10")).cast("double")
        ),
    )


def max_samples(
    df: DataFrame, dataset: str, order: str, limit: int, salts: int = 32
) -> DataFrame:
    """The first ``limit`` rows of each dataset; a hot dataset is thinned in salted groups first."""
    from pyspark.sql import Window

    salt = F.pmod(F.xxhash64(order), F.lit(salts))
    near = Window.partitionBy(dataset, "_salt").orderBy(order)
    final = Window.partitionBy(dataset).orderBy(order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(near))
        .filter(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= limit)
        .drop("_salt", "_rank")
    )
