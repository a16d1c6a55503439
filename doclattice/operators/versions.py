"""Comparison of two versions of a surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, present
from .fuzzy import rename_score
from .predicates import first_wins, last_wins, side_by_side

SEVERITY = {"function": "high", "class": "high", "interface": "medium", "type": "medium", "enum": "medium", "variable": "low"}


def _side(df: DataFrame, side: str, key: str) -> DataFrame:
    return df.select(F.col(key), F.lit(True).alias(f"in_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != key])


def spec_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(id, change, kind): breaking (gone, or another structure), added, docs-only; equal ids are left out.

    Both sides have id, kind, shape (what callers see) and docs (what readers see); one full
    outer join, in which a missing side and a null value are different things.
    """
    both = _side(old.select(key, "kind", "shape", "docs"), "old", key).join(_side(new.select(key, "kind", "shape", "docs"), "new", key), key, "full_outer")
    gone, fresh = F.col("in_new").isNull(), F.col("in_old").isNull()
    change = F.when(gone, "removed").when(fresh, "added").when(~F.col("old_shape").eqNullSafe(F.col("new_shape")) | ~F.col("old_kind").eqNullSafe(F.col("new_kind")), "changed").when(~F.col("old_docs").eqNullSafe(F.col("new_docs")), "docs")
    df = both.select(F.col(key), change.alias("reason"), F.coalesce("old_kind", "new_kind").alias("kind")).where("reason IS NOT NULL")
    return df.select(key, F.when(F.col("reason").isin("removed", "changed"), "breaking").when(F.col("reason") == "added", "added").otherwise("docs-only").alias("change"), "reason", "kind")


def breaking_severity(diff: DataFrame) -> DataFrame:
    """Breaking changes with severity by kind and the order of the list: high first, then by id."""
    severity = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("kind")), F.lit("low"))
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return diff.where("change = 'breaking'").select("id", "kind", "reason", severity.alias("severity")).withColumn("rank", rank)


def semver_bump(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and the bump: major if anything breaks, minor if anything is added, patch for docs, else none."""
    counts = diff.groupBy(*(by or [])).agg(*[F.count_if(F.col("change") == k).alias(n) for k, n in (("breaking", "breaking"), ("added", "added"), ("docs-only", "docs_only"))])
    return counts.withColumn("bump", F.when(F.col("breaking") > 0, "major").when(F.col("added") > 0, "minor").when(F.col("docs_only") > 0, "patch").otherwise("none"))


def next_version(version: Column | str, bump: Column | str) -> Column:
    v = F.split(F.regexp_replace(F.col(version) if isinstance(version, str) else version, r"[-+].*$", ""), r"\.")
    part = lambda k: F.coalesce(F.try_element_at(v, F.lit(k)).cast("int"), F.lit(0))
    join = lambda *p: F.concat_ws(".", *[x.cast("string") for x in p])
    zero = F.lit(0)
    b = F.col(bump) if isinstance(bump, str) else bump
    return F.when(b == "major", join(part(1) + 1, zero, zero)).when(b == "minor", join(part(1), part(2) + 1, zero)).when(b == "patch", join(part(1), part(2), part(3) + 1)).otherwise(join(part(1), part(2), part(3)))


def member_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members (class, member, pos, kind, signature) added, removed or with another signature; the last of equal names counts.

    A removed member is shown the likest new one of its class: an added one if there is any.
    """
    keys = ["class", "member"]
    a, b = (last_wins(x.where("member IS NOT NULL"), keys, "pos") for x in (old, new))
    both = a.select(*keys, F.lit(True).alias("in_old"), F.col("kind").alias("old_kind"), F.col("signature").alias("old_signature")).join(b.select(*keys, F.lit(True).alias("in_new"), F.col("kind").alias("new_kind"), F.col("signature").alias("new_signature")), keys, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_signature").eqNullSafe(F.col("new_signature")), "signature-changed")
    df = both.withColumn("change", change).where("change IS NOT NULL").select(*keys, F.coalesce("new_kind", "old_kind").alias("kind"), "change", "old_signature", "new_signature")
    # renames are sought within a class
    gone = df.where("change = 'removed'").select("class", F.col("member").alias("source"))
    fresh = df.where("change = 'added'").select("class", F.col("member").alias("candidate"))
    any_added = fresh.select("class").distinct()
    pool = fresh.unionByName(b.select("class", F.col("member").alias("candidate")).join(any_added, "class", "left_anti"))
    scored = gone.join(pool, "class").withColumn("score", rename_score(F.col("source"), F.col("candidate"))).where("score >= 0.5")
    best = scored.groupBy("class", "source").agg(F.max(F.struct("score", F.col("candidate"))).alias("b")).select("class", F.col("source").alias("member"), F.lit("removed").alias("change"), F.col("b.candidate").alias("suggestion"))
    return df.join(best, ["class", "member", "change"], "left")


def distinct_changes(changes: DataFrame) -> DataFrame:
    """Changes of members (class, member, change, pos), each once; the first counts."""
    return first_wins(changes, ["class", "member", "change"], "pos")


def change_kind(diff: DataFrame, new_names: DataFrame) -> DataFrame:
    """What a breaking change (id) means for documentation: ``removed`` where the new side lacks the name, else ``signature-changed``."""
    there = new_names.select(F.col("name").alias("id"), F.lit(True).alias("there")).distinct()
    return diff.where("change = 'breaking'").join(there, "id", "left").select("id", F.when(F.col("there").isNull(), "removed").otherwise("signature-changed").alias("kind"))


def signatures_equal(a: Column | str, b: Column | str) -> Column:
    """Equality of two signatures as JSON text: the order of keys matters, and a missing one equals a missing one only."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return x.eqNullSafe(y)


def coverage_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: mean stored scores of both sides (missing is 0, empty is 0), exports that got better or worse by id."""
    mean = lambda df, n: df.agg(F.coalesce(half_up(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0)))), F.lit(0)).alias(n))
    both = old.select("id", F.col("score").alias("a")).join(new.select("id", F.col("score").alias("b")), "id")
    moved = both.agg(F.count_if(F.col("b") > F.col("a")).alias("improved"), F.count_if(F.col("b") < F.col("a")).alias("regressed"))
    df = side_by_side(mean(old, "old_coverage"), mean(new, "new_coverage"), moved)
    return df.withColumn("delta", F.col("new_coverage") - F.col("old_coverage"))


def issue_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    df = side_by_side(old.agg(F.count("*").alias("old_issues")), new.agg(F.count("*").alias("new_issues")))
    return df.withColumns({"introduced": F.greatest(F.lit(0), F.col("new_issues") - F.col("old_issues")), "resolved": F.greatest(F.lit(0), F.col("old_issues") - F.col("new_issues"))})


def new_undocumented(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.where(~present("description")).join(old.select("id"), "id", "left_anti").select("id")


def hash_diff(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Files (path, hash) that changed, went or came; changed and removed ones first."""
    both = cached.select("path", F.col("hash").alias("h1")).join(current.select("path", F.col("hash").alias("h2")), "path", "full_outer").where(~F.col("h1").eqNullSafe(F.col("h2")))
    return both.select("path", F.when(F.col("h2").isNull(), "removed").when(F.col("h1").isNull(), "added").otherwise("changed").alias("change"))


def cache_state(checks: dict[str, Column]) -> Column:
    """The first check that fails, in the order given; ``valid`` if none does."""
    out = None
    for reason, ok in checks.items():
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out.otherwise("valid")


# -- documentation of a change


def export_references(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Imports (each) and calls (once a block, unless imported there) of known names in code facts.

    ``facts``: path, block, pos, fact (import, call), name, line.
    """
    known = facts.join(names.select("name").distinct(), "name", "left_semi")
    imports = known.where("fact = 'import'")
    w = Window.partitionBy("path", "block", "name").orderBy("pos")
    calls = known.where("fact = 'call'").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    calls = calls.join(imports.select("path", "block", "name").distinct(), ["path", "block", "name"], "left_anti")
    return imports.unionByName(calls).select("path", "block", "pos", "name", "fact", "line")


def docs_impact(facts: DataFrame, member_changes: DataFrame, changed: DataFrame) -> DataFrame:
    """Places of the docs that a change touches: calls of changed members, new instances of their classes, references to changed exports.

    ``member_changes``: class, member, change; ``changed``: name, change.
    """
    last = last_wins(member_changes, ["member"], "class")
    calls = facts.where("fact = 'method'").join(last.select(F.col("member").alias("name"), "change"), "name").select("path", "block", "line", "name", "change", F.lit("call").alias("via"))
    classes = member_changes.select(F.col("class").alias("name")).distinct()
    made = facts.where("fact = 'new'").join(classes, "name").select("path", "block", "line", "name", F.lit("member").alias("change"), F.lit("new").alias("via"))
    plain = changed.join(classes, "name", "left_anti")
    refs = export_references(facts, plain).join(plain, "name").select("path", "block", "line", "name", "change", F.lit("reference").alias("via"))
    return calls.unionByName(made).unionByName(refs).dropDuplicates(["path", "block", "name", "via"])


def impact_stats(impact: DataFrame) -> DataFrame:
    return impact.agg(F.count_distinct("path").alias("files"), F.count_distinct("path", "block").alias("blocks"), F.count("*").alias("references"))


def undocumented_names(names: DataFrame, doc_words: DataFrame) -> DataFrame:
    """Names that no page mentions as a word (word)."""
    return names.select("name").distinct().join(doc_words.select(F.col("word").alias("name")).distinct(), "name", "left_anti")


def report_join(analysis: DataFrame, exports: DataFrame) -> DataFrame:
    """Analyses (export_key, score, issues) with their export; of equal keys the first export counts, missing issues are none."""
    first = first_wins(exports, ["export_key"], "export_pos")
    return analysis.join(first.select("spec_id", "export_key", "export_pos", "name", "kind"), "export_key", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))


def diff_with_docs(old: DataFrame, new: DataFrame, old_issues: DataFrame, new_issues: DataFrame) -> DataFrame:
    """One row for two versions: changes by kind, coverage and issues on both sides, exports without a description that came with the new one.

    Both sides have id, kind, shape, docs, score and description.
    """
    changes = semver_bump(spec_diff(old, new))
    fresh = new_undocumented(old, new).agg(F.count("*").alias("new_undocumented"))
    return side_by_side(changes, coverage_delta(old, new), issue_delta(old_issues, new_issues), fresh)
