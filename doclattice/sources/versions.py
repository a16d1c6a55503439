"""Surfaces over time: snapshots by ref, and the two sides of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import specs


def save_version(exports: DataFrame, root: str, ref: str) -> None:
    """Keep a surface under a ref; a partition, so reading one prunes the others, and saving it again replaces it."""
    exports.withColumn("ref", F.lit(ref)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ref").parquet(root)


def load_version(spark: SparkSession, root: str, ref: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("ref") == ref).drop("ref")


def both_sides(spark: SparkSession, base: str | None = None, head: str | None = None, files: tuple[str, ...] = (), root: str | None = None, live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Old and new: refs of a version table (head defaults to the live surface), else two files, else one file and the live surface."""
    if base and root:
        new = load_version(spark, root, head) if head else live
        if new is None:
            raise ValueError("a head ref or a live surface is needed")
        return load_version(spark, root, base), new
    if len(files) == 2:
        return specs(spark, files[0]), specs(spark, files[1])
    if len(files) == 1 and live is not None:
        return specs(spark, files[0]), live
    raise ValueError("give refs, two files, or one file and a live surface")
