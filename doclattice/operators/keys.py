"""Coverage of option keys: what a type declares against what pages document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_replacement


def type_keys(members: DataFrame) -> DataFrame:
    """Keys of each type; of a key's declarations (pos) the last value that isn't null counts for each attribute.

    ``members``: type, key, pos, deprecated, reason, internal.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    return members.groupBy("type", "key").agg(F.min("pos").alias("pos"), last("deprecated"), last("reason"), last("internal"))


def all_type_keys(members: DataFrame) -> DataFrame:
    """Keys of any type, each once."""
    return members.where("key IS NOT NULL").select("key").distinct()


def candidate_types(keys: DataFrame, least: int = 3) -> DataFrame:
    """Types with enough keys to be documented by a table."""
    return keys.groupBy("type").agg(F.count_distinct("key").alias("n")).where(F.col("n") >= least).select("type")


def key_coverage(code: DataFrame, documented: DataFrame, all_keys: DataFrame, mentions: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    """One row for each key of a page: documented, ghost, other-type, or a gap with its class.

    ``code``: page, key, deprecated, reason, internal; ``documented``: page, key; ``all_keys``: key of
    any type; ``mentions``: page, key named in prose; ``ignored``: page, key. Gap classes, first that
    fits: prose-documented, internal, deprecated, user-facing.
    """
    a = code.select("page", "key", "deprecated", "reason", "internal", F.lit(True).alias("in_code"))
    d = documented.select("page", "key").distinct().withColumn("in_docs", F.lit(True))
    df = a.join(d, ["page", "key"], "full_outer")
    known = all_keys.select("key").distinct().withColumn("known", F.lit(True))
    df = df.join(known, "key", "left")
    for name, other in (("mentioned", mentions), ("skip", ignored)):
        df = df.join(other.select("page", "key").distinct().withColumn(name, F.lit(True)), ["page", "key"], "left") if other is not None else df.withColumn(name, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(yes("in_code") & yes("in_docs"), "documented")
        .when(~yes("in_code") & yes("known"), "other-type")
        .when(~yes("in_code"), "ghost")
        .when(yes("skip"), "ignored")
        .when(yes("mentioned"), "prose-documented")
        .when(F.col("key").startswith("_") | yes("internal"), "internal")
        .when(yes("deprecated"), "deprecated")
        .otherwise("user-facing")
    )
    return df.select("page", "key", status.alias("status"), yes("deprecated").alias("deprecated"), parse_replacement("reason").alias("replacement"))


def inversions(coverage: DataFrame) -> DataFrame:
    """Documented keys that are deprecated in favour of a key that isn't documented."""
    old = coverage.where("status = 'documented' AND deprecated AND replacement IS NOT NULL").select("page", "key", "replacement")
    have = coverage.where("status = 'documented'").select("page", F.col("key").alias("replacement"))
    return old.join(have, ["page", "replacement"], "left_anti").select("page", "key", "replacement")


def page_gate(coverage: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per page: counts and status; fails on ghosts or more user-facing gaps than the baseline (default 0), warns on other gaps and inversions."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = coverage.groupBy("page").agg(n("ghost").alias("ghosts"), n("user-facing").alias("gaps"), n("documented").alias("documented"))
    out = out.join(inversions(coverage).groupBy("page").agg(F.count("*").alias("inversions")), "page", "left").join(baselines.select("page", "baseline"), "page", "left").fillna(0, ["inversions", "baseline"])
    bad = (F.col("ghosts") > 0) | (F.col("gaps") > F.col("baseline"))
    return out.withColumn("status", F.when(bad, "fail").when((F.col("gaps") > 0) | (F.col("inversions") > 0), "warn").otherwise("pass"))


def lowered_baselines(baselines: DataFrame, gate: DataFrame) -> DataFrame:
    """Baselines set where missing and lowered where there are fewer gaps, never raised."""
    return gate.select("page", "gaps").join(baselines.select("page", "baseline"), "page", "full_outer").select("page", F.least(F.coalesce("baseline", "gaps"), F.coalesce("gaps", "baseline")).alias("baseline"))


def page_candidates(documented: DataFrame, keys: DataFrame, least: int = 3, top: int = 3) -> DataFrame:
    """The types that share most keys with each page; at least ``least`` keys on the page and in common."""
    pages = documented.select("page", "key").distinct()
    large = pages.groupBy("page").count().where(F.col("count") >= least).select("page")
    shared = pages.join(large, "page", "left_semi").join(keys.select("type", "key").distinct(), "key").groupBy("page", "type").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    w = Window.partitionBy("page").orderBy(F.col("overlap").desc(), "type")
    return shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ordered_keys(coverage: DataFrame) -> DataFrame:
    """Keys of a page with their place in two orders: by code unit, and as people sort them."""
    by = lambda k: Window.partitionBy("page").orderBy(k)
    return coverage.select("page", "key").distinct().withColumns({"by_code": F.row_number().over(by(F.col("key"))), "by_name": F.row_number().over(Window.partitionBy("page").orderBy(F.collate("key", "UNICODE")))})
