"""Coverage, health and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, half_up, percent
from .predicates import CATEGORIES, category, documented, is_external, side_by_side

REQUIREMENTS = {
    "minimal": {"description": True, "params": False, "returns": False, "examples": False},
    "verbose": {"description": True, "params": True, "returns": True, "examples": True},
    "types-only": {"description": False, "params": True, "returns": True, "examples": False},
}
RULES = ("description", "params", "returns", "throws", "examples")


def requirements(style: str = "minimal", **overrides: bool | None) -> dict[str, bool]:
    """A preset with single requirements replaced."""
    return REQUIREMENTS[style] | {k: v for k, v in overrides.items() if v is not None}


# -- one export


def export_score(df: DataFrame, required: dict[str, bool] | None = None) -> DataFrame:
    """Adds ``score`` and ``missing``.

    Needs kind, description, n_params and n_doc_params (first signature), has_returns,
    doc_returns, n_throws, doc_throws, has_example. Weights: description 30, params 25 (in
    proportion), returns 20, throws 10 (asked for whenever something is thrown), examples 15.
    """
    need = required or requirements()
    ok = documented()
    takes = F.col("kind").isin("function", "class") & (F.col("n_params") > 0)
    gives = (F.col("kind") == "function") & F.col("has_returns")
    throws = F.col("n_throws") > 0
    zero = F.lit(0)
    ratio = half_up(25.0 * F.col("n_doc_params").cast("double") / F.nullif(F.col("n_params"), zero).cast("double"))
    rules = [
        (F.lit(need["description"]), F.lit(30), F.when(ok, 30).otherwise(0)),
        (F.lit(need["params"]) & takes, F.lit(25), F.when(F.col("n_doc_params") >= F.col("n_params"), 25).otherwise(ratio)),
        (F.lit(need["returns"]) & gives, F.lit(20), F.when(F.col("doc_returns"), 20).otherwise(0)),
        (throws, F.lit(10), F.when(F.col("doc_throws"), 10).otherwise(0)),
        (F.lit(need["examples"]), F.lit(15), F.when(F.col("has_example"), 15).otherwise(0)),
    ]
    total = sum((F.when(asked, most).otherwise(zero) for asked, most, _ in rules), zero)
    points = sum((F.when(asked, got).otherwise(zero) for asked, _, got in rules), zero)
    missing = F.array_compact(F.array(F.when(~ok, "description"), F.when(takes & (F.col("n_doc_params") < F.col("n_params")), "params"), F.when(gives & ~F.col("doc_returns"), "returns"), F.when(throws & ~F.col("doc_throws"), "throws"), F.when(~F.col("has_example"), "examples")))
    return df.withColumns({"score": percent(points, total), "missing": missing})


# -- overloads and packages


def overload_rollup(scored: DataFrame) -> DataFrame:
    """One row per (spec_id, name): the best overload (the earliest on ties), missing rules of all, issues added up."""
    best = F.struct("score", (-F.col("export_pos")).alias("__p"), "export_key")
    return scored.groupBy("spec_id", "name").agg(
        F.max(best).alias("__b"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing"), F.sum("issues").alias("issues"), F.count("*").alias("overloads")
    ).select("spec_id", "name", F.col("__b.export_key").alias("export_key"), F.col("__b.score").alias("score"), "missing", "issues", "overloads")


def spec_totals(rolled: DataFrame) -> DataFrame:
    """Per spec: exports, fully documented ones, average score."""
    return rolled.groupBy("spec_id").agg(F.count("*").alias("total"), F.count_if(F.size("missing") == 0).alias("complete"), F.sum("issues").alias("issues"), F.coalesce(half_up(F.avg("score")), F.lit(100)).alias("score"))


def package_coverage(exports: DataFrame, skip_external: bool = True, skip_internal: bool = False) -> DataFrame:
    """Per package: exports, documented ones, coverage."""
    df = exports
    if skip_external:
        df = df.where(~is_external())
    if skip_internal:
        df = df.where(~F.col("internal"))
    return df.groupBy("spec_id").agg(F.count("*").alias("exports"), F.count_if(documented()).alias("documented")).withColumn("score", percent("documented", "exports"))


def coverage_rollup(exports: DataFrame) -> DataFrame:
    """Package rows and their pooled total (null package) in one aggregation."""
    return exports.where(~is_external()).rollup("spec_id").agg(F.count("*").alias("exports"), F.count_if(documented()).alias("documented")).withColumn("score", percent("documented", "exports"))


def batch_scan(coverage: DataFrame, issues: DataFrame, minimum: int) -> DataFrame:
    """Package rows with issue counts, health and whether the minimum is met; packages without issues count zero."""
    n = issues.groupBy("spec_id").agg(F.count("*").alias("issues"), F.count_distinct("export_key").alias("with_issues"))
    df = coverage.join(n, "spec_id", "left").fillna(0, ["issues", "with_issues"])
    df = df.withColumn("health", health_by_exports("exports", "documented", "with_issues"))
    return df.withColumn("passes", F.col("health") >= minimum)


def initial_threshold(coverage: DataFrame) -> DataFrame:
    """Five points below the worst package, not below zero."""
    return coverage.agg(F.greatest(F.lit(0), F.min("score") - 5).alias("threshold"))


# -- health


def health_by_issues(coverage, exports, issues, passed=None, examples=None) -> dict[str, Column]:
    """Score, accuracy and example score: up to half is lost to issues, up to 30 % to failing examples."""
    none = F.lit(0)
    cov, n, k, p, e = (col(none if x is None else x).cast("double") for x in (coverage, exports, issues, passed, examples))
    penalty = F.when(n > 0, F.least(0.5 * k / F.nullif(n, F.lit(0.0)), F.lit(0.5))).otherwise(F.lit(0.0))
    share = F.when(e > 0, half_up(100.0 * p / F.nullif(e, F.lit(0.0)))).otherwise(F.lit(100))
    return {"completeness": half_up(cov), "accuracy": half_up(100.0 * (1 - penalty)), "examples_score": share, "score": half_up(cov * (1 - penalty) * (1 - 0.3 * (100 - share) / 100.0))}


def health_by_exports(total, doc, with_issues) -> Column:
    """Half completeness, half share of documented exports without issues."""
    n, d, k = (col(x).cast("double") for x in (total, doc, with_issues))
    complete = percent(d, n)
    accurate = F.when(d > 0, half_up(100.0 * F.greatest(F.lit(0.0), d - k) / F.nullif(d, F.lit(0.0)))).otherwise(F.lit(100))
    return half_up(0.5 * complete + 0.5 * accurate)


def weighted_health(packages: DataFrame) -> DataFrame:
    """Totals over packages, with health and coverage weighted by exports; zero without exports."""
    n = F.sum("exports").cast("double")
    mean = lambda c: F.coalesce(half_up(F.sum(F.col(c).cast("double") * F.col("exports")) / F.nullif(n, F.lit(0.0))), F.lit(0))
    return packages.agg(F.sum("exports").alias("exports"), F.sum("documented").alias("documented"), F.sum("issues").alias("issues"), mean("health").alias("health"), mean("coverage").alias("coverage"))


def stored_coverage(exports: DataFrame) -> DataFrame:
    """Mean of stored scores, with full or no points by description where none is stored; 100 without exports."""
    return exports.agg(F.coalesce(half_up(F.avg(F.coalesce(F.col("stored_score").cast("double"), F.when(documented(), 100.0).otherwise(0.0)))), F.lit(100)).alias("coverage"))


# -- issue counts


def issue_pivot(findings: DataFrame) -> DataFrame:
    """Issues of each spec by category; all categories are columns."""
    c = category("type")
    return findings.groupBy("spec_id").agg(*[F.count_if(c == k).alias(k) for k in sorted(set(CATEGORIES.values()))], F.count("*").alias("total"))


def missing_pivot(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("spec_id").agg(*[F.count_if(F.array_contains("missing", r)).alias(f"no_{r}") for r in RULES])


def surface_completeness(referenced: DataFrame, exports: DataFrame, ignored: DataFrame) -> DataFrame:
    """Types that are referenced but not exported (spec_id, name), and the share that is exported."""
    forgotten = referenced.select("spec_id", "name").distinct().join(exports.select("spec_id", "name"), ["spec_id", "name"], "left_anti").join(ignored.select("name"), "name", "left_anti")
    n = exports.groupBy("spec_id").agg(F.count_distinct("name").alias("exported"))
    return n.join(forgotten.groupBy("spec_id").agg(F.count("*").alias("forgotten")), "spec_id", "left").fillna(0, ["forgotten"]).withColumn("completeness", percent("exported", F.col("exported") + F.col("forgotten")))


def example_presence(exports: DataFrame) -> DataFrame:
    return exports.groupBy("spec_id").agg(F.count("*").alias("total"), F.count_if("has_example").alias("with_examples"), F.array_sort(F.collect_list(F.when(~F.col("has_example"), F.col("name")))).alias("missing"))


def example_counts(errors: DataFrame, examples: DataFrame) -> DataFrame:
    """Passed and failed examples: one with any error fails, blank ones don't count."""
    bad = errors.select("export_key", "ex_pos").distinct().withColumn("failed", F.lit(True))
    real = examples.where(F.length(F.trim("code")) > 0)
    return real.join(bad, ["export_key", "ex_pos"], "left").agg(F.count("*").alias("total"), F.count_if(F.col("failed").isNull()).alias("passed"), F.count_if("failed").alias("failed"))


def release_readiness(coverage: DataFrame, issues: DataFrame, undocumented: DataFrame, minimum: int) -> DataFrame:
    """One row: gates, the reasons that hold a release back, the first ten undocumented names."""
    c = coverage.agg(percent(F.sum("documented"), F.sum("exports")).alias("coverage"))
    i = issues.agg(F.count("*").alias("issues"))
    names = undocumented.orderBy("name").limit(10).agg(F.array_sort(F.collect_list("name")).alias("undocumented"))
    df = side_by_side(c, i, names)
    reasons = F.array_compact(F.array(F.when(F.col("coverage") < minimum, F.concat(F.lit("coverage "), F.col("coverage").cast("string"), F.lit(f" below {minimum}"))), F.when(F.col("issues") > 0, F.concat(F.col("issues").cast("string"), F.lit(" issues")))))
    return df.withColumns({"reasons": reasons, "ready": F.size(reasons) == 0})


def probe(exports: DataFrame) -> DataFrame:
    """One row for a single package: coverage, and the health that it has while no issue is known."""
    c = exports.where(~is_external()).agg(F.count("*").alias("exports"), F.count_if(documented()).alias("documented")).withColumn("coverage", percent("documented", "exports"))
    return c.withColumn("health", half_up(0.5 * F.col("coverage") + 50))


def analysis_of(exports: DataFrame, analyses: DataFrame) -> DataFrame:
    """Exports with their analysis (export_key, score, missing): full marks and nothing missing where there is none."""
    none = F.array().cast("array<string>")
    return exports.join(analyses, "export_key", "left").withColumns({"score": F.coalesce("score", F.lit(100)), "missing": F.coalesce("missing", none)}).withColumn("complete", F.size("missing") == 0)
