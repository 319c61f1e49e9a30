"""Request logs: demos, prefixes shared between requests, budgeted batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.functions import tokens
from sparkloom.operators.greedy import Budget, greedy_cuts
from sparkloom.operators.lookups import lookup_join
from sparkloom.operators.ordering import shuffle_key, with_global_index


def few_shot_join(items: DataFrame, demos: DataFrame, shots: int, seed: int, chunks: int | None = None) -> DataFrame:
    """``shots`` different demos per item: a run of a seeded demo order from a seeded place.

    An equi join on the demo's place; demos are never paired with all items. Without demos every
    list is empty.
    """
    placed = with_global_index(
        demos.withColumn("_mix", shuffle_key(seed, "demo_id")), "_mix", "demo_id", name="_place", chunks=chunks
    ).select("_place", "demo")
    total = demos.count()
    if total == 0:
        kind = T.ArrayType(demos.schema["demo"].dataType)
        return items.select("item_id", F.array().cast(kind).alias("demos"))
    base = F.conv(F.substring(shuffle_key(seed, "item_id"), 1, 7), 16, 10).cast("bigint")
    slots = items.select(
        "item_id", F.explode(F.sequence(F.lit(0), F.lit(min(shots, total) - 1))).alias("slot"), base.alias("base")
    ).withColumn("_place", F.pmod(F.col("base") + F.col("slot"), F.lit(total)))
    return (
        lookup_join(slots, placed, "_place")
        .groupBy("item_id")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "demo"))).alias("s"))
        .select("item_id", F.transform("s", lambda x: x["demo"]).alias("demos"))
    )


_LINKS = 256  # blocks linked before their hashes are put aside


def chain_hashes(ids: Column, block: int) -> Column:
    """Hash of every full block and all blocks before it.

    Hashes are gathered in runs of ``_LINKS``, so that a long text does not copy
    one growing array at every block. Pass a plain column: it is read inside a
    lambda, where an expression would be worked out again for every block.
    """
    blocks = F.floor(F.size(ids) / block).cast("int")
    runs = F.ceil(blocks / _LINKS).cast("int")

    def part_of(i: Column) -> Column:
        last = F.least((i + 1) * _LINKS, blocks) - 1
        return F.transform(F.sequence(i * _LINKS, last), lambda b: F.slice(ids, b * block + 1, F.lit(block)))

    places = F.when(runs > 0, F.sequence(F.lit(0), runs - 1)).otherwise(F.array().cast("array<int>"))

    def link(acc: Column, part: Column) -> Column:
        # the last hash of the run is its state; the first entry came from the run before
        return F.array_append(acc, F.xxhash64(F.element_at(acc, -1), part))

    def run(acc: Column, part: Column) -> Column:
        start = F.array(F.element_at(acc["run"], -1))
        return F.struct(
            F.aggregate(part, start, link).alias("run"), F.array_append(acc["done"], acc["run"]).alias("done")
        )

    first = F.struct(F.array(F.lit(-1).cast("bigint")).alias("run"), F.array().cast("array<array<bigint>>").alias("done"))
    return F.aggregate(
        F.transform(places, part_of),
        first,
        run,
        # each run starts with the hash before it, which is left out
        lambda acc: F.flatten(
            F.transform(F.array_append(acc["done"], acc["run"]), lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))
        ),
    )


def block_prefixes(requests: DataFrame, block: int, ids: str = "token_ids") -> DataFrame:
    """(seq_id, block_no, chain_hash, block_hash) of each full block, narrow."""
    full = tokens.token_blocks(F.col(ids), block, full_only=True)
    zipped = F.arrays_zip(
        chain_hashes(F.col(ids), block).alias("chain"),
        F.transform(full, lambda b: F.md5(F.array_join(b.cast("array<string>"), " "))).alias("check"),
    )
    return requests.select("seq_id", F.posexplode(zipped).alias("block_no", "z")).select(
        "seq_id", "block_no", F.col("z.chain").alias("chain_hash"), F.col("z.check").alias("block_hash")
    )


def first_seen_prefix(prefixes: DataFrame) -> DataFrame:
    """One row per distinct prefix: its first request and how many hold it.

    Equal chains must also have equal last blocks. Map-side combined, so a prefix
    held by a third of the requests costs one row per task.
    """
    return prefixes.groupBy("chain_hash", "block_hash", "block_no").agg(
        F.min("seq_id").alias("first_seq"), F.count("*").alias("requests")
    )


def prefix_groups(prefixes: DataFrame) -> DataFrame:
    """Prefixes held by more than one request."""
    return first_seen_prefix(prefixes).filter(F.col("requests") > 1)


def prefix_reuse(requests: DataFrame, block: int, ids: str = "token_ids") -> DataFrame:
    """Tokens of each request whose blocks an earlier request already held.

    A request is the first holder of all its blocks but the reused ones, and a
    chain covers everything before it, so reused blocks are the leading ones.
    Counting first holders needs no join from blocks back to hot prefixes.
    """
    held = requests.select("seq_id", F.floor(F.size(ids) / block).alias("full_blocks"))
    new = (
        first_seen_prefix(block_prefixes(requests, block, ids))
        .groupBy(F.col("first_seq").alias("seq_id"))
        .agg(F.count("*").alias("new_blocks"))
    )
    reused = F.col("full_blocks") - F.coalesce("new_blocks", F.lit(0))
    return held.join(new, "seq_id", "left").select(
        "seq_id", "full_blocks", reused.alias("cached_blocks"), (reused * block).alias("cached_tokens")
    )


def token_budget_batches(
    requests: DataFrame, max_tokens: int = 16384, max_requests: int = 512, order: str = "seq_id",
    chunks: int | None = None,
) -> DataFrame:
    """Batches in arrival order, within a request and a token budget.

    Rows (batch_no, seq_id, from_token, to_token). A request over the token budget
    is cut, and only ever starts a batch.
    """
    queue = requests.select(F.lit(0).alias("_queue"), F.col(order).alias("seq_id"), F.greatest("n", F.lit(1)).alias("n"))
    cuts = greedy_cuts(queue, "_queue", ["seq_id"], Budget(max_tokens, max_requests), chunks=chunks)
    parts = F.when(F.col("_starts"), F.ceil(F.col("n") / max_tokens)).otherwise(1).cast("int")
    return cuts.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")).select(
        (F.col("_cut") + F.col("_part")).alias("batch_no"),
        "seq_id",
        (F.col("_part") * max_tokens).cast("int").alias("from_token"),
        F.when(F.col("_starts"), F.least(F.col("n"), (F.col("_part") + 1) * max_tokens))
        .otherwise(F.col("n"))
        .cast("int")
        .alias("to_token"),
    )
