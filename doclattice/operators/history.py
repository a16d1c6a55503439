"""Trends over an append-only history of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import documented_share, half_up, sparkline, week_start
from .predicates import side_by_side


def snapshot(exports: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: exports, documented ones (description or tag), issues, coverage (100 if empty)."""
    return side_by_side(exports.agg(F.count("*").alias("exports"), F.count_if("documented").alias("documented")), issues.agg(F.count("*").alias("issues"))).withColumn("coverage", documented_share())


def trend(history: DataFrame, window: int = 10) -> DataFrame:
    """Newest snapshot of each package: change against the one before and a spark line of the last ``window``.

    ``history``: package, date, seq, coverage.
    """
    back = Window.partitionBy("package").orderBy(F.col("date").desc(), F.col("seq").desc())
    # a limit of each package, which tasks apply before the shuffle: no package is gathered whole
    recent = history.select("package", "date", "seq", "coverage").withColumn("age", F.row_number().over(back)).where(F.col("age") <= max(window, 2))
    in_window = F.when(F.col("age") <= window, F.struct((-F.col("age")).alias("k"), "coverage"))
    series = F.transform(F.array_sort(F.collect_list(in_window)), lambda s: s["coverage"])
    at = lambda n: F.max(F.when(F.col("age") == n, F.col("coverage")))
    out = recent.groupBy("package").agg(at(1).alias("current"), at(2).alias("previous"), series.alias("series"))
    return out.select("package", "current", (F.col("current") - F.col("previous")).alias("delta"), "series", sparkline("series").alias("bars"))


def velocity(history: DataFrame, now: str, days: int) -> DataFrame:
    """Points per day between the first and the last snapshot of the last ``days``; 0 below two rows or one day.

    ``history``: package, ts, coverage.
    """
    recent = history.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    key = F.struct("ts", "seq")
    out = recent.groupBy("package").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("coverage", key).alias("c0"), F.max_by("coverage", key).alias("c1"))
    span = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))).cast("double") / 86_400e6
    points = F.floor(100.0 * (F.col("c1") - F.col("c0")).cast("double") / F.nullif(span, F.lit(0.0)) + 0.5) / 100.0
    return out.select("package", F.when((F.col("n") >= 2) & (span >= 1), points).otherwise(F.lit(0.0)).alias("velocity"), F.col("c1").alias("current"))


def projection(df: DataFrame, days: int = 30) -> DataFrame:
    """Coverage in ``days`` at the present velocity, within 0 to 100."""
    return df.withColumn("projected", F.least(F.lit(100), F.greatest(F.lit(0), half_up(F.col("current") + days * F.col("velocity")))))


def weekly(history: DataFrame) -> DataFrame:
    """Weeks from Sunday: average, first, last, change and number of snapshots."""
    key = F.struct("date", "seq")
    out = history.withColumn("week", week_start("date")).groupBy("package", "week").agg(half_up(F.avg("coverage")).alias("average"), F.min_by("coverage", key).alias("first"), F.max_by("coverage", key).alias("last"), F.count("*").alias("snapshots"))
    return out.withColumn("delta", F.col("last") - F.col("first"))


def extremes(history: DataFrame) -> DataFrame:
    return history.groupBy("package").agg(F.max("coverage").alias("best"), F.min("coverage").alias("worst"), F.min("date").alias("since"), F.max("date").alias("until"))


def package_trends(history: DataFrame) -> DataFrame:
    """First, last and change of coverage, latest lint count; days are condensed first so that arrays stay short."""
    key = F.struct("date", "seq")
    daily = history.groupBy("package", "date").agg(F.max_by("coverage", "seq").alias("coverage"), F.max_by("lint", "seq").alias("lint"), F.min_by("coverage", "seq").alias("opening"), F.max("seq").alias("seq"))
    return daily.groupBy("package").agg(
        F.min_by("opening", key).alias("first"), F.max_by("coverage", key).alias("last"), F.max_by("lint", key).alias("lint"), F.transform(F.array_sort(F.collect_list(F.struct("date", "coverage"))), lambda s: s["coverage"]).alias("coverage_by_day")
    ).withColumn("delta", F.col("last") - F.col("first"))


def attention(trends: DataFrame, minimum: int) -> DataFrame:
    """Packages below the minimum or with issues, worst first."""
    return trends.where((F.col("last") < minimum) | (F.col("lint") > 0)).select("package", "last", "lint").orderBy("last", "package")


def ratchet(history: DataFrame, minimum: int, per_package: bool = False) -> DataFrame:
    """The best coverage so far raises the minimum; a best of zero doesn't count."""
    keys = ["package"] if per_package else []
    top = history.groupBy(*keys).agg(F.max("coverage").alias("watermark"), F.min_by("date", F.struct((-F.col("coverage")).alias("c"), F.col("date"), F.col("seq"))).alias("reached"))
    some = F.col("watermark") > 0
    return top.select(*keys, F.when(some, F.col("watermark")).alias("watermark"), F.when(some, F.col("reached")).alias("reached"), F.greatest(F.lit(minimum), F.when(some, F.col("watermark"))).alias("minimum"))


def daily_average(history: DataFrame) -> DataFrame:
    return history.groupBy("date").agg(half_up(F.avg("coverage")).alias("average"))


def window_delta(history: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Average of the newest day against the oldest day within ``days``."""
    recent = daily_average(history).where(F.col("date").between(F.date_sub(F.lit(today).cast("date"), days), F.lit(today).cast("date")))
    return recent.agg(F.min_by("average", "date").alias("from"), F.max_by("average", "date").alias("to")).withColumn("delta", F.col("to") - F.col("from"))


def retained(history: DataFrame, keep: int = 100) -> DataFrame:
    """The newest ``keep`` snapshots of each package."""
    w = Window.partitionBy("package").orderBy(F.col("date").desc(), F.col("seq").desc())
    return history.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")
