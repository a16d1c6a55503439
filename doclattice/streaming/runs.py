"""Runs that can be resumed: results are appended as they come, what is missing is found by a join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def start(stream: DataFrame, analyze: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Analyze micro-batches and append the results; a batch that is repeated after a failure replaces its own part."""

    def store(batch: DataFrame, number: int) -> None:
        analyze(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a run has not analyzed yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


class Progress(StreamingQueryListener):
    """Calls back with the number of rows of each batch and at the end."""

    def __init__(self, on_batch: Callable[[int, int], None], on_end: Callable[[], None] = lambda: None):
        self.on_batch, self.on_end = on_batch, on_end

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.on_batch(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.on_end()


def stale(spark: SparkSession, folder: str, now: str, hours: int = 1) -> DataFrame:
    """Files of interrupted runs that are older than ``hours``."""
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    return files.where(F.col("modificationTime") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")).select("path")
