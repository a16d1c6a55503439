"""Results kept by content: a table under a key that holds everything that it depends on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.versions import cache_state
from .storage import shared_root


def source_fingerprint(hashes: DataFrame) -> str:
    """One digest of a file table (path, hash): an order-free sum of row digests, so it takes one aggregation."""
    row = hashes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("path", "hash").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{row[0]}-{row[1]}"


def key(version: str, fingerprint: str, config: dict | None = None) -> str:
    text = json.dumps([version, fingerprint, config or {}], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached(spark: SparkSession, name: str, build: Callable[[], DataFrame], root: str | None = None, refresh: bool = False) -> tuple[DataFrame, bool]:
    """The table kept under ``name``, built and written if it isn't there whole; and whether it was."""
    place = f"{root or shared_root(spark)}/cache-{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if there and not refresh:
        return spark.read.parquet(place), True
    build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place), False


def validity(version: Column, entry: Column, config: Column, compiler: Column, manifest: Column, sources: Column) -> Column:
    """Why a kept result can't be used: the first of these comparisons that fails, in this order, else ``valid``."""
    return cache_state({"version": version, "entry": entry, "config": config, "compiler-config": compiler, "manifest": manifest, "sources": sources})


def newest_change(files: DataFrame) -> DataFrame:
    """Last modification of a source tree (path, modified)."""
    return files.agg(F.max("modified").alias("modified"))
