"""Tables between the steps of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and there is a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _LOCAL:
        _LOCAL[own] = tempfile.mkdtemp(prefix="doclattice-")
    return _LOCAL[own]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts lineage and survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
