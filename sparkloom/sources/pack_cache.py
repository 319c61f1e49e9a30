"""Packed rows and metrics at rest."""

from __future__ import annotations

import hashlib
import json
import logging
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.session import remove_path
from sparkloom.sources.corpus import PACK_COLUMNS, move_path, path_exists, require_columns

log = logging.getLogger(__name__)


def cache_path(cache_dir: str, raw_path: str, suffix: str, max_len: int, **parameters) -> str:
    """``{base}_{suffix}_packed_maxseq{N}_{fingerprint}.parquet``.

    The fingerprint covers every other parameter that changes the rows.
    """
    base = posixpath.basename(raw_path.rstrip("/"))
    mark = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:10]
    return posixpath.join(cache_dir, f"{base}_{suffix.lower()}_packed_maxseq{max_len}_{mark}.parquet")


def write_pack_cache(packs: DataFrame, path: str) -> bool:
    """Write packs once; a failure is logged and the caller goes on with the rows.

    Packs are written beside their place and moved there when whole, so a write that failed leaves no
    cache. What is left there from one that is not whole gives way.
    """
    spark = packs.sparkSession
    beside = f"{path}-{uuid.uuid4().hex}"
    try:
        if path_exists(spark, f"{path}/_SUCCESS"):
            raise FileExistsError(path)
        packs.write.mode("errorifexists").parquet(beside)
        remove_path(spark, path)
        if not move_path(spark, beside, path):
            raise OSError(f"could not move {beside}")
        return True
    except Exception as error:  # the rows are still there to be used
        log.error("could not write %s: %s", path, error)
        return False


def read_pack_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached packs, or None when there are none that can be read."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    try:
        return require_columns(spark.read.parquet(path), *PACK_COLUMNS)
    except Exception as error:
        log.warning("packing again, %s is not readable: %s", path, error)
        return None


def cached_packs(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the cache, else build, write and read back."""
    hit = read_pack_cache(spark, path)
    if hit is not None:
        return hit
    packs = build()
    if write_pack_cache(packs, path):
        return read_pack_cache(spark, path)
    return packs


def metrics_json(metrics: DataFrame, step: str, name: str, value: str) -> DataFrame:
    """One JSON object per step: the step, then its metrics by name."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(name), F.col(value).cast("double"))))
    whole = F.map_concat(F.create_map(F.lit("step"), F.col(step).cast("double")), F.map_from_entries("pairs"))
    return metrics.groupBy(step).agg(pairs.alias("pairs")).select(step, F.to_json(whole).alias("json"))


def metrics_json_sink(metrics: DataFrame, path: str, step: str = "step", name: str = "metric", value: str = "value") -> None:
    metrics_json(metrics, step, name, value).select("json").write.mode("append").text(path)
