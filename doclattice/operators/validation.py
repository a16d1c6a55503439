"""Checks of result tables, as constraint columns: each row carries what it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import CATEGORIES
from .scoring import RULES


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break rules, with their names in ``errors``; an unknown outcome is a breach."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))).where(F.size("errors") > 0)


def check_findings(findings: DataFrame) -> DataFrame:
    return violations(findings, {"type is unknown": F.col("type").isin(*CATEGORIES), "export_key is missing": F.col("export_key").isNotNull(), "target is missing": F.col("target").isNotNull()})


def check_analysis(rolled: DataFrame) -> DataFrame:
    """Export analyses: score in range, known rules, counts that aren't negative."""
    return violations(rolled, {"score is out of range": F.col("score").between(0, 100), "unknown rule": F.forall("missing", lambda r: r.isin(*RULES)), "issues are negative": F.col("issues") >= 0, "name is missing": F.col("name").isNotNull()})


def check_totals(totals: DataFrame) -> DataFrame:
    return violations(totals, {"complete exceeds total": F.col("complete") <= F.col("total"), "score is out of range": F.col("score").between(0, 100)})
