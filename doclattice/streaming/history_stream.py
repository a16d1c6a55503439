"""An extension: the history log as a stream, with weekly rollups for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "ts timestamp, package string, coverage int, lint int"


def read_log(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """New files of the log folder; malformed lines have a null time and are dropped."""
    return spark.readStream.schema(schema).json(folder).where("ts IS NOT NULL")


def weekly_rollup(stream: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Weeks from Sunday by package; rows may be late by ``lateness``, which bounds the state."""
    week = F.window("ts", "7 days", startTime="3 days")  # the epoch was a Thursday
    return stream.withWatermark("ts", lateness).groupBy(week, "package").agg(F.avg("coverage").alias("average"), F.max("coverage").alias("best"), F.count("*").alias("snapshots")).select(F.to_date("window.start").alias("week"), "package", F.floor(F.col("average") + 0.5).cast("int").alias("average"), "best", "snapshots")


def finished(weeks: DataFrame, log: DataFrame, columns: tuple[str, ...] = ("week", "package")) -> DataFrame:
    """Weeks that a stream appended and, as its log has ended, a batch rollup of those it left open."""
    return weeks.unionByName(weekly_rollup(log).join(weeks.select(*columns), list(columns), "left_anti"))


def alerts(stream: DataFrame, minimum: int) -> DataFrame:
    return stream.where((F.col("coverage") < minimum) | (F.col("lint") > 0))


def write_weekly(rollup: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append finished weeks as Parquet; with ``once`` what is there is processed and the query ends."""
    writer = rollup.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
