"""Reading raw items and packed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Column names of the data model.
RAW_COLUMNS = ("context", "question", "answer", "metadata")

PACK_COLUMNS = ("input_ids", "labels", "seq_lengths", "task_ids", "task_type", "range_ids")

# Column types of packed rows as training reads them.
PACK_READ_TYPES = {
    "input_ids": "array<bigint>",
    "labels": "array<bigint>",
    "seq_lengths": "array<int>",
    "task_ids": "array<bigint>",
    "task_type": "array<string>",
    "range_ids": "array<array<bigint>>",
}


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return fs.exists(target)


def move_path(spark: SparkSession, source: str, place: str) -> bool:
    target, fs = _hadoop_path(spark, place)
    return fs.rename(_hadoop_path(spark, source)[0], target)


def is_file(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return fs.getFileStatus(target).isFile()


def has_parquet(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    if not fs.exists(target):
        return False
    if fs.getFileStatus(target).isFile():
        return True
    return any(s.isFile() and s.getPath().getName().endswith(".parquet") for s in fs.listStatus(target))


def read_parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.parquet`` files directly in a folder, or one file."""
    if not has_parquet(spark, path):
        raise ValueError(f"no parquet files found in {path}")
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)


def _total_bytes(spark: SparkSession, path: str) -> int:
    target, fs = _hadoop_path(spark, path)
    return fs.getContentSummary(target).getLength()


def spread_small(df: DataFrame, path: str) -> DataFrame:
    """Deal the rows of an input too small to fill the cluster's cores to all of them.

    For costly work per row only. An input of more than one full split per core is
    left as it is read, so at scale this adds no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return df.repartition(cores) if _total_bytes(spark, path) < cores * split else df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Raw items. Files without an ``item_id`` get one from file path and row number."""
    raw = require_columns(read_parquet_files(spark, path), *RAW_COLUMNS)
    if "item_id" not in raw.columns:
        row = F.lpad(F.col("_metadata.row_index").cast("string"), 15, "0")
        raw = raw.withColumn("item_id", F.concat_ws(":", F.col("_metadata.file_path"), row))
    return spread_small(raw, path)


def typed_pack_items(packs: DataFrame) -> DataFrame:
    """Fixed-width types for packed rows; other columns stay."""
    require_columns(packs, *PACK_COLUMNS)
    return packs.select(
        *[F.col(c).cast(PACK_READ_TYPES[c]).alias(c) if c in PACK_READ_TYPES else F.col(c) for c in packs.columns]
    )


def multi_dataset_scan(spark: SparkSession, names: str, paths: str, limits: str | int | None = None) -> DataFrame:
    """Comma-separated dataset names and paths (and token limits): one tagged read each, united."""
    tags, places = names.split(","), paths.split(",")
    caps = str(limits).split(",") if limits is not None else [None]
    caps = caps * len(tags) if len(caps) == 1 else caps
    if not len(tags) == len(places) == len(caps):
        raise ValueError("datasets, files and limits must have the same number of parts")
    out = None
    for tag, place, cap in zip(tags, places, caps):
        part = read_parquet_files(spark, place.strip()).withColumns(
            {"dataset": F.lit(tag.strip()), "max_length": F.lit(int(cap) if cap else None).cast("int")}
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
