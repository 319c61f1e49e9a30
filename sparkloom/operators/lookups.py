"""Lookups of many rows, with hot keys, in a table of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.session import cut

BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1000


def measure_table(table: DataFrame, key: str) -> int:
    """Bytes of a lookup table, as JSON text; a key with several rows is an error."""
    size = F.octet_length(F.to_json(F.struct(*table.columns)))
    per_key = table.groupBy(key).agg(F.count("*").alias("_rows"), F.sum(size).alias("_bytes"))
    found = per_key.agg(F.max(F.when(F.col(key).isNotNull(), F.col("_rows"))).alias("rows"), F.sum("_bytes").alias("bytes")).first()
    if (found["rows"] or 0) > 1:
        raise ValueError(f"a {key} has several rows in the lookup table")
    return found["bytes"] or 0


def lookup_join(big: DataFrame, table: DataFrame, key: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of ``big`` with a table that has one row per key.

    The table is measured, and broadcast only when it stays within ``limit_bytes``.
    """
    if measure_table(table, key) <= limit_bytes:
        return big.join(F.broadcast(table), key, "left")
    return split_join(big, table, key)


def split_join(big: DataFrame, table: DataFrame, key: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The same join for a table of any size.

    The most frequent keys of ``big`` (a fixed number) meet their table rows by
    broadcast and are never shuffled; any other key has at most 1/``hot_keys`` of
    the rows and is joined by a shuffle. Rows with a null key find nothing and stay where
    they are. ``big`` is cut, since it is read for its frequencies and for each part.
    """
    big = cut(big)
    often = (
        big.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_uses"))
        .orderBy(F.col("_uses").desc(), key)
        .limit(hot_keys)
    )
    hot = cut(often.select(key, F.lit(True).alias("_hot")))
    hot_table = table.join(F.broadcast(hot.select(key)), key, "left_semi")
    marked = big.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
    first = marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot_table), key, "left")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot").join(table, key, "left")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != key]
    none = big.filter(F.col(key).isNull()).select("*", *blank)
    return first.unionByName(rest).unionByName(none)
