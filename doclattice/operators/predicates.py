"""Row predicates and small projections over the surface tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, present, trim, truthy

EXTERNAL = "<external>"
_KINDS = {
    "structural": "generic-constraint-mismatch property-type-mismatch async-mismatch optionality-mismatch return-type-mismatch param-mismatch param-type-mismatch",
    "semantic": "broken-link deprecated-mismatch visibility-mismatch",
    "example": "example-assertion example-identifier example-runtime example-syntax",
    "prose": "prose-deprecated prose-import prose-member",
}
#: Category of each type of finding.
CATEGORIES = {kind: group for group, kinds in _KINDS.items() for kind in kinds.split()}
EXECUTABLE = ("ts", "typescript", "tsx", "js", "javascript", "jsx", "mts", "mjs", "cts", "cjs", "ts-twoslash", "node")


def is_external(file: Column | str = "source_file", package: Column | str = "source_package") -> Column:
    """Re-exported from elsewhere: the file says so, or there is a package without a file."""
    return F.coalesce(col(file) == EXTERNAL, F.lit(False)) | (col(package).isNotNull() & col(file).isNull())


def documented(description: Column | str = "description") -> Column:
    """By description alone."""
    return present(description)


def documented_or_tagged(description: Column | str = "description", tag_names: Column | str = "tag_names") -> Column:
    """By description or by any tag but the internal one."""
    return present(description) | F.coalesce(F.exists(col(tag_names), lambda t: t != "internal"), F.lit(False))


def documented_raw(docs: Column | str, description: Column | str) -> Column:
    """By either text, blank or not."""
    return truthy(F.coalesce(F.nullif(col(docs), F.lit("")), col(description)))


def has_internal_tag(tag_names: Column | str = "tag_names") -> Column:
    return F.coalesce(F.array_contains(col(tag_names), "internal"), F.lit(False))


def release_tag(tag_names: Column | str = "tag_names") -> Column:
    """The first release tag; untagged is public."""
    return F.coalesce(F.try_element_at(F.filter(col(tag_names), lambda t: t.isin("public", "beta", "alpha", "internal")), F.lit(1)), F.lit("public"))


def parse_list(x: Column | str) -> Column:
    """Distinct parts of a comma-separated text that aren't blank, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(col(x), ","), trim), lambda v: v != ""))


def looks_like_path(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"^\.|[/\\]|\.(?:[cm]?[jt]sx?|json|mdx?)$"), F.lit(False))


def executable_language(lang: Column | str, languages: tuple[str, ...] = EXECUTABLE) -> Column:
    return F.coalesce(F.lower(col(lang)).isin(*languages), F.lit(False))


def category(kind: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), col(kind))


def gate(health: Column | str, minimum: Column | str, docs_pass: Column | str | None = None) -> Column:
    return (col(health) >= col(minimum)) & (F.coalesce(col(docs_pass), F.lit(True)) if docs_pass is not None else F.lit(True))


def has_filters(*lists: Column | str) -> Column:
    """Whether any of the lists has an entry."""
    out = F.lit(False)
    for x in lists:
        out = out | (F.coalesce(F.size(col(x)), F.lit(0)) > 0)
    return out


#: Names that a language and its libraries define: primitives, utility types, collections, errors.
BUILTIN_TYPES = tuple(
    "any bigint boolean false function never null number object string symbol this true undefined unknown void "
    "Array ArrayBuffer AsyncGenerator AsyncIterable AsyncIterator Awaited BigInt Boolean Buffer Capitalize ConstructorParameters DataView Date Error EvalError Exclude Extract File FormData Function Generator Headers "
    "Infinity InstanceType Iterable IterableIterator Iterator JSON Lowercase Map Math NaN NoInfer NonNullable Number Object Omit Parameters Partial Pick Promise PromiseLike Proxy RangeError Readonly ReadonlyArray ReadonlyMap ReadonlySet "
    "Record ReferenceError Reflect RegExp Request Required Response ReturnType Set SharedArrayBuffer String Symbol SyntaxError ThisType TypeError URIError URL URLSearchParams Uncapitalize Uppercase WeakMap WeakRef WeakSet".split()
)
#: Methods of arrays, texts, maps, promises and the like, which any local value may have.
BUILTIN_METHODS = tuple(
    "add all any apply at bind call catch charAt clear concat delete endsWith entries every fill filter finally find findIndex findLast flat flatMap forEach get has hasOwnProperty includes indexOf join keys lastIndexOf length map match matchAll next "
    "padEnd padStart pop push race reduce reduceRight repeat replace replaceAll reverse search set shift slice some sort splice split startsWith substring then toFixed toISOString toLocaleString toLowerCase toString toUpperCase trim trimEnd trimStart unshift valueOf values".split()
)


def builtin_type_name(name: Column | str) -> Column:
    """A type parameter, an anonymous type, a name of the language or of a family of its libraries."""
    n = col(name)
    return F.coalesce(n.rlike("^[A-Z]$") | n.startswith("__") | n.isin(*BUILTIN_TYPES) | n.rlike(r"^(?:(?:Big)?(?:Int|Uint|Float)(?:8|16|32|64)(?:Clamped)?Array|(?:HTML|SVG)\w*Element|\w+Event(?:Map|Init)?|Intl\w*)$"), F.lit(False))


def builtin_methods(spark) -> DataFrame:
    """The built-in methods as a table (name), a fixed list."""
    return spark.createDataFrame([(m,) for m in BUILTIN_METHODS], "name string")


# -- first and last of equal keys


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key; null keys are keys like others."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return first_wins(df, keys, *[F.col(o).desc() for o in order])


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Results of one row each as one row: a union and an aggregation, so nothing is joined."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(F.col(f"`{c}`")).alias(c) for r in rows for c in r.columns])


# -- selecting exports


def select_exports(exports: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, visibility: list[str] | None = None) -> DataFrame:
    """Exports by id or name (case ignored), exclusion first, and by release tag; no include list means all.

    ``include`` and ``exclude`` have one column, ``name``. Both sides are keyed, so large lists shuffle
    and small ones are broadcast by the optimizer.
    """
    out = exports
    keys = lambda t: t.select(F.lower(trim("name")).alias("__k")).distinct()
    if include is not None:
        wanted = keys(include)
        if not wanted.isEmpty():
            hits = out.join(wanted, F.lower("export_key") == F.col("__k"), "left_semi").select("spec_id", "export_key").unionByName(out.join(wanted, F.lower("name") == F.col("__k"), "left_semi").select("spec_id", "export_key")).distinct()
            out = out.join(hits, ["spec_id", "export_key"], "left_semi")
    if exclude is not None:
        gone = keys(exclude)
        out = out.join(gone, F.lower("export_key") == F.col("__k"), "left_anti").join(gone, F.lower("name") == F.col("__k"), "left_anti")
    if visibility:
        out = out.where(release_tag().isin(*visibility))
    return out


def missing_names(wanted: DataFrame, exports: DataFrame) -> DataFrame:
    """Wanted names that no export has: a diagnostic of the selection."""
    w = wanted.select(trim("name").alias("name"), F.lower(trim("name")).alias("__k"))
    have = exports.select(F.lower("name").alias("__k")).unionByName(exports.select(F.lower("export_key").alias("__k"))).distinct()
    return w.join(have, "__k", "left_anti").select("name").distinct()


def merge_filters(df: DataFrame) -> DataFrame:
    """Columns include_a, include_b, exclude_a, exclude_b: what both include, what either excludes."""
    both = F.when(F.size("include_a") == 0, F.col("include_b")).when(F.size("include_b") == 0, F.col("include_a")).otherwise(F.array_intersect("include_a", "include_b"))
    return df.select("*", both.alias("include"), F.array_union("exclude_a", "exclude_b").alias("exclude"))


def changed_packages(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Packages (dir) with a changed file (path) below them; without files all of them.

    A file is exploded to its parent folders, so the prefix test is an equi-join.
    """
    if files.isEmpty():
        return packages
    parts = F.split("path", "/")
    parents = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir")).distinct()
    return packages.join(parents, "dir", "left_semi")


def page(df: DataFrame, number: int, per_page: int, *order: str) -> DataFrame:
    """One page of an ordered list; a number outside is clamped to the first or last page."""
    pages = max(1, -(-df.count() // per_page))
    at = min(max(1, number), pages)
    return df.orderBy(*order).offset((at - 1) * per_page).limit(per_page)
