"""Choosing values, blocks and items: thresholds, top shares, draws, cumulative mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.operators.ordering import shuffle_key
from sparkloom.session import cut

# A bisection of [0, 1] down to 1e-8 takes 27 halvings, so it ends on this grid.
_BITS, _LOW_BITS = 27, 13


def threshold_for_share(df: DataFrame, target: float, value: str = "value") -> DataFrame:
    """The threshold a bisection on [0, 1] to 1e-8 ends with, where values up to it make
    up at most ``target`` of all.

    Two counting passes over grid cells instead of 27 over the data: cells of 2^-14
    find the crossing, its 2^13 sub-cells the end point. Both group tables have a
    fixed size and are combined map-side.
    """
    # least grid point not below the value; all beyond the grid count as its end, so the tables keep their size
    grid = F.least(F.col(value) * float(1 << _BITS), F.lit(float(1 << _BITS)))
    cell = F.greatest(F.ceil(grid), F.lit(0))
    cells = df.select(cell.alias("_cell"))
    high = F.shiftright("_cell", _LOW_BITS)
    coarse = cells.groupBy(high.alias("_high")).agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        coarse.select(
            "_high",
            F.sum("_n").over(upto).alias("_sum"),
            (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
            F.sum("_n").over(Window.partitionBy()).alias("_total"),
        )
        .withColumn("_allowed", F.col("_total") * target)
        .filter(F.col("_sum") > F.col("_allowed"))
        .orderBy("_high")
        .limit(1)
    )
    fine = (
        cells.withColumn("_high", high)
        .join(F.broadcast(crossing), "_high")  # one row
        .groupBy("_cell", "_before", "_allowed", "_total")
        .agg(F.count("*").alias("_n"))
    )
    inner = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first_over = (
        fine.withColumn("_sum", F.col("_before") + F.sum("_n").over(inner))
        .filter(F.col("_sum") > F.col("_allowed"))
        .agg(F.min("_cell").alias("_cell"))
    )
    last = F.lit((1 << _BITS) - 1)
    lower = F.greatest(F.least(F.coalesce(F.col("_cell") - 1, last), last), F.lit(0))
    return first_over.select(((lower + 0.5) / float(1 << _BITS)).alias("threshold"))


def order_key(value: Column) -> Column:
    """A double as a whole number of 64 bits in the same order; NaN is largest, null smallest, both zeros are one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value, F.lit(0.0)) + F.lit(0.0)).cast("bigint")
    ordered = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.when(value.isNull(), F.lit(-(1 << 63))).otherwise(ordered)


def kth_largest(df: DataFrame, key: str, k: int) -> tuple[int, int]:
    """The k-th largest of a column of 64-bit whole numbers, and how many are larger. ``k`` is at least 1 and at most the row count.

    Four counting passes, 16 bits each from the top: every pass counts, map-side, the rows that share the prefix found so
    far by their next bits, in a table of at most 65,536 rows. No row is moved.
    """
    prefix, larger = None, 0
    for shift in (48, 32, 16, 0):
        rows = df if prefix is None else df.filter(F.shiftright(key, shift + 16) == prefix)
        counts = {r["p"]: r["count"] for r in rows.groupBy(F.shiftright(key, shift).alias("p")).count().collect()}
        for prefix in sorted(counts, reverse=True):
            if larger + counts[prefix] >= k:
                break
            larger += counts[prefix]
    return prefix, larger


def round_top_share(df: DataFrame, keys: list[str], target: float, value: str = "value", seed: int = 42) -> DataFrame:
    """The largest int(total * (1 - target)) values become 10, the rest -10.

    Ties fall in a repeatable random order. The threshold is found by counting, and so is the one among the ties; rows
    are not sorted, and stay where they are. Nulls are smallest, NaN is largest.
    """
    mix = shuffle_key(seed, *keys)
    tie = -F.conv(F.substring(mix, 1, 15), 16, 10).cast("bigint")  # the smallest hash comes first
    rows = cut(df.select(*keys, value).withColumns({"_key": order_key(F.col(value).cast("double")), "_tie": tie}))
    high = int(rows.count() * (1.0 - target))
    on, off = F.lit(10.0), F.lit(-10.0)
    if high == 0:
        return rows.select(*keys, value, off.alias("rounded"))
    threshold, larger = kth_largest(rows, "_key", high)
    ties = rows.filter(F.col("_key") == threshold)
    last, before = kth_largest(ties, "_tie", high - larger)
    is_in = (F.col("_key") > threshold) | ((F.col("_key") == threshold) & (F.col("_tie") > last))
    # rows that share 60 bits of the hash with the last one: this one, or its copies
    same = (F.col("_key") == threshold) & (F.col("_tie") == last)
    place = F.row_number().over(Window.partitionBy("_tie").orderBy(mix, *keys))
    few = rows.filter(same).withColumn("_in", place <= high - larger - before)
    decided = rows.filter(~same).withColumn("_in", is_in).unionByName(few)
    return decided.select(*keys, value, F.when(F.col("_in"), on).otherwise(off).alias("rounded"))


def any_gate(df: DataFrame, *keys: str, flag: str = "keep") -> DataFrame:
    """A group takes the full path when any member does."""
    return df.groupBy(*keys).agg(F.bool_or(flag).alias("full_path"), F.count("*").alias("members"))


def last_token(df: DataFrame, *keys: str, pos: str = "pos", columns: list[str]) -> DataFrame:
    """The last row of each sequence."""
    last = F.max_by(F.struct(pos, *columns), pos)
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


_STEP = 64.0  # exponents of one part differ by less than this, so its sum cannot overflow
_LAST_STEPS = 2  # a part three steps down is under e^-128 of the top one's largest term


def scale_softmax(df: DataFrame, key: str, value: str, temperature: float) -> DataFrame:
    """Softmax of value / temperature inside each group.

    Sums of exponentials are kept apart per step of 64 and put on the scale of the
    highest step at the end, so map-side aggregates replace a pass for the
    maximum; steps too low to change the sum are left out, and nothing of a group is gathered. Rows
    meet their group's sum in the last join, where a hot group can be split. Null is a group.
    """
    x = F.col(value) / F.lit(temperature)
    step = F.floor(x / _STEP)
    parts = df.groupBy(F.col(key), step.alias("_step")).agg(F.sum(F.exp(x - step * _STEP)).alias("_sum"))
    tops = parts.groupBy(F.col(key).alias("_k")).agg(F.max("_step").alias("_top"))
    scaled = F.col("_sum") * F.exp((F.col("_step") - F.col("_top")) * _STEP)
    totals = (
        parts.join(tops, F.col(key).eqNullSafe(F.col("_k")))
        .filter(F.col("_step") >= F.col("_top") - _LAST_STEPS)
        .groupBy("_k")
        .agg(F.first("_top").alias("_top"), F.sum(scaled).alias("_sum"))
    )
    share = F.exp(x - F.col("_top") * _STEP) / F.col("_sum")
    return df.join(totals, F.col(key).eqNullSafe(F.col("_k"))).select(*df.columns, share.alias("share"))


def weighted_pick(
    df: DataFrame, key: str, item: str, value: str, u: str, temperature: float, floor: float = 1e-10
) -> DataFrame:
    """One draw per group in proportion to softmax(value / temperature).

    The draw is argmax of share / noise with exponential noise -ln(u). The share's
    denominator is the same for the whole group, so the logarithm of the rest is
    enough and one map-side aggregate does the draw. Ties go to the lower item.
    """
    noise = F.greatest(-F.log(F.col(u)), F.lit(floor))
    score = F.col(value) / F.lit(temperature) - F.log(noise)
    return df.groupBy(key).agg(
        F.max(F.struct(score.alias("score"), (-F.col(item)).alias("minus"))).alias("_top"), F.count("*").alias("items")
    ).select(key, (-F.col("_top.minus")).alias(item), "items")


def top_p_blocks(
    scores: DataFrame, share: float | Column, causal: bool = True, first_chunk: int | None = None, decimals: int = 9,
    keys: tuple[str, ...] = ("seq_id",),
) -> DataFrame:
    """Key blocks kept for each query block of ``keys`` (a sequence, or its heads): block 0 and the own block always, then by
    falling score while the mass before a block is under ``share`` of the row's mass.

    ``share`` may be a column, such as a threshold per head. ``first_chunk``: query blocks below it follow the literal rule of the first
    chunk, where only the own block counts as forced and the mass of a later block
    leaves out the block just before it. A row has one entry per key block of one
    sequence, so its window is bounded by the sequence length.
    """
    own = F.col("kb") == F.col("qb")
    sink = F.col("kb") == 0
    needed_share = share if isinstance(share, Column) else F.lit(share)
    row = Window.partitionBy(*keys, "qb")

    def chosen(forced: Column, skip: int) -> Column:
        ordered = row.orderBy(F.when(forced, 0).otherwise(1), F.col("score").desc(), "kb")
        before = F.coalesce(F.sum("score").over(ordered.rowsBetween(Window.unboundedPreceding, -skip)), F.lit(0.0))
        needed = F.sum("score").over(row) * needed_share
        return F.round(before, decimals) < F.round(needed, decimals)

    if causal:
        keep = chosen(own | sink, 1) | own | sink
        if first_chunk is not None:
            keep = F.when(F.col("qb") < first_chunk, chosen(own, 2) | own | sink).otherwise(keep)
        keep = keep & (F.col("kb") <= F.col("qb"))
    else:
        # rejected places of the sorted row are written to block 0
        keep = chosen(F.lit(False), 1) | sink
    return scores.withColumn("keep", keep)
