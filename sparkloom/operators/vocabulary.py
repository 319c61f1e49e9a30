"""One vocabulary that grows: ids are dense, never change, and turn back into their tokens.

A vocabulary is a folder of versions. A new version holds the tokens that no earlier one has, numbered behind them in the order of
the tokens, so texts encoded with an old version stay valid. Rows of tokens are encoded in blocks of bounded size: a block's
distinct tokens are numbered and looked up, and its rows, which hold these numbers, meet them by one exchange; no row per token is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkloom.operators.lookups import BROADCAST_BYTES
from sparkloom.operators.ordering import with_global_index
from sparkloom.session import stage
from sparkloom.sources.corpus import path_exists

BLOCK_BYTES = 32 << 20
_SCHEMA = "token string, id long"


def versions(spark: SparkSession, path: str) -> int:
    """Number of versions that were written whole."""
    count = 0
    while path_exists(spark, f"{path}/version={count + 1}/_SUCCESS"):
        count += 1
    return count


def read_vocabulary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(token, id, version) as of a version, the last one by default."""
    last = versions(spark, path) if version is None else version
    if last == 0:
        return spark.createDataFrame([], f"{_SCHEMA}, version int")
    parts = [
        spark.read.schema(_SCHEMA).parquet(f"{path}/version={k}").withColumn("version", F.lit(k)) for k in range(1, last + 1)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def append_tokens(rows: DataFrame, path: str, tokens: str = "tokens", chunks: int | None = None) -> int:
    """Add the tokens of a column of arrays that are new; returns the version that has them all.

    Nothing is written when none is new. A second writer of the same version gets an error and may try again.
    """
    spark = rows.sparkSession
    last = versions(spark, path)
    known = read_vocabulary(spark, path, last)
    distinct = rows.select(F.explode(F.array_distinct(tokens)).alias("token")).filter("token IS NOT NULL").distinct()
    fresh = distinct.join(known.select("token"), "token", "left_anti") if last else distinct
    numbered = with_global_index(fresh, "token", name="id", chunks=chunks).select("token", "id")
    base = known.agg(F.max("id")).first()[0] if last else None
    first = 0 if base is None else base + 1
    if last and numbered.isEmpty():
        return last
    numbered.select("token", (F.col("id") + first).alias("id")).write.mode("errorifexists").parquet(f"{path}/version={last + 1}")
    return last + 1


def _blocked(place: int, names: list[str], block_bytes: int):
    """Batches of rows with a block number: rows of a task in a row, about ``block_bytes`` of their column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            column = batch.column(place)
            each = max(1, column.nbytes // max(1, batch.num_rows))
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            mean = column.nbytes / max(1, int(lengths.sum()))
            upto = held + np.cumsum(np.maximum(lengths * mean, each / 16)).astype(np.int64)
            blocks = block + upto // block_bytes
            if len(upto):
                held = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks)], names=names)

    return run


def _coded(place: int, names: list[str], kind: pa.DataType):
    """Rows with their block, in order, to rows whose column holds codes, numbers of the block's distinct entries.

    The entries of a block are a row of their own, with nothing else than ``_block`` and ``_entries``.
    """

    def close(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [pa.concat_arrays([r.column(k) for r in rows]) for k in range(rows[0].num_columns)]
        lists, n = columns[place], len(columns[0])
        coded = lists.flatten().dictionary_encode()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        columns[place] = pa.ListArray.from_arrays(pa.array(offsets), coded.indices, mask=lists.is_null())
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(kind))], names=names)
        entries = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(kind))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, c.type) for c in columns[:-1]], columns[-1].slice(0, 1), entries], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            blocks = batch.column(batch.num_columns - 1).to_numpy()
            starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for first, last in zip(starts, [*starts[1:], len(blocks)]):
                if blocks[first] != block and rows:
                    yield from close(rows)
                    rows = []
                block = blocks[first]
                rows.append(batch.slice(first, last - first))
        if rows:
            yield from close(rows)

    return run


def _replaced(column: str, out: str, value: str, kind: pa.DataType):
    """Rows of a block and its entries to the rows with each code replaced; unknown entries are null."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        lists = rows.column(column).combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        codes = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        numbers = known.column("_code").to_numpy()
        spots = np.full(max(codes.max(initial=-1), numbers.max(initial=-1)) + 2, -1)  # the last one is for code -1
        spots[numbers] = np.arange(len(numbers))
        places = spots[codes]
        values = known.column(value).combine_chunks().cast(kind)
        found = pc.take(values, pa.array(places, mask=places < 0))
        found = found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)
        made = pa.ListArray.from_arrays(pa.array(offsets), found, mask=lists.is_null())
        kept = rows.drop_columns([column, "_block"])
        return kept.append_column(out, made)

    return run


def _looked_up(entries: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a vocabulary: tokens and ids are unique, so only its size is measured before a broadcast.

    A block has an entry once, so the rows of a key are no more than the blocks, and a shuffle needs no care for hot keys.
    """
    size = table.agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return entries.join(F.broadcast(table), key, "left")
    return entries.join(table, key, "left")


def _translate(rows: DataFrame, table: DataFrame, column: str, out: str, key: str, value: str, block_bytes: int) -> DataFrame:
    """Replace the entries of an array column by a table of one row per key."""
    place, kept = rows.columns.index(column), rows.schema[column].dataType
    fields = [T.StructField(f.name, T.ArrayType(T.IntegerType()) if f.name == column else f.dataType) for f in rows.schema.fields]
    schema = T.StructType([*fields, T.StructField("_block", T.LongType()), T.StructField("_entries", kept)])
    number = _blocked(place, schema.names[:-1], block_bytes)
    code = _coded(place, schema.names, pa.string() if isinstance(kept.elementType, T.StringType) else pa.int64())
    blocked = stage(rows.mapInArrow(lambda batches: code(number(batches)), schema), "blocks")
    whole = blocked.filter("_entries IS NOT NULL").select(F.col("_block").alias("_of"), F.posexplode("_entries").alias("_code", key))
    entries = whole.filter(F.col(key).isNotNull())
    known = _looked_up(entries, table.select("token", "id"), key).filter(F.col(value).isNotNull())
    kind = table.schema[value].dataType
    result = T.StructType([*[f for f in rows.schema.fields if f.name != column], T.StructField(out, T.ArrayType(kind))])
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    made = (
        blocked.filter("_entries IS NULL").drop("_entries").groupBy("_block")
        .cogroup(known.select("_of", "_code", value).groupBy("_of"))
        .applyInArrow(_replaced(column, out, value, arrow), result)
    )
    return made


def encode(rows: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", ids: str = "ids", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` with ids in place of tokens. A token that the vocabulary lacks is null; a null array stays null."""
    return _translate(rows, vocabulary, tokens, ids, "token", "id", block_bytes)


def decode(rows: DataFrame, vocabulary: DataFrame, ids: str = "ids", tokens: str = "tokens", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` with tokens in place of ids. An id that the vocabulary lacks is null."""
    return _translate(rows, vocabulary, ids, tokens, "id", "token", block_bytes)
