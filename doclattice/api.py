"""One function for each command: compositions of operators that return DataFrames.

``Surface`` holds the flat tables of one or more API surfaces; detectors that lack their
tables are left out. Nothing runs before a result is used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.scalars import percent
from .operators import findings, fuzzy, history, keys, predicates, prose, registry, scoring, versions
from .sinks import render

VERSION = "0.2.0"


@dataclass
class Options:
    """Defaults of the commands."""

    minimum: int = 0
    lint: bool = True
    skip_external: bool = True
    requirements: dict[str, bool] = field(default_factory=scoring.requirements)


@dataclass
class Surface:
    exports: DataFrame
    params: DataFrame | None = None
    doc_params: DataFrame | None = None
    returns: DataFrame | None = None
    visibility: DataFrame | None = None
    link_texts: DataFrame | None = None
    members: DataFrame | None = None
    facts: DataFrame | None = None
    package: str = ""
    type_params: DataFrame | None = None
    doc_type_params: DataFrame | None = None
    property_tags: DataFrame | None = None
    example_facts: DataFrame | None = None
    examples: DataFrame | None = None
    example_results: DataFrame | None = None
    builtins: DataFrame | None = None


def _gates(exports: DataFrame) -> DataFrame:
    """Exports with what the detectors' gates read; a surface that says nothing of tags or examples may have both."""
    out = exports
    for name in ("has_tags", "has_example"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(True))
    return out if "export_pos" in out.columns else out.withColumn("export_pos", F.lit(0))


def lint(s: Surface, options: Options = Options()) -> DataFrame:
    """All findings in the order of the detectors, each for the exports that have what it reads; none where linting is off.

    Detectors of parameters, results, type parameters, deprecation, visibility, promises and
    properties; then examples; then links; then what running the examples gave.
    """
    tags: list[DataFrame | tuple[DataFrame, list[str]]] = []
    if s.params is not None and s.doc_params is not None:
        tags.append((findings.parameters(s.params, s.doc_params), findings.PARAMETERS))
    if s.returns is not None:
        tags.append(findings.return_types(s.returns))
    if s.type_params is not None and s.doc_type_params is not None:
        tags.append(findings.generic_constraints(s.type_params, s.doc_type_params))
    tags.append(findings.deprecation(s.exports))
    if s.visibility is not None:
        tags.append(findings.visibility(s.visibility))
    if s.returns is not None:
        tags.append(findings.asynchrony(s.returns))
    if s.property_tags is not None:
        tags.append(findings.property_types(s.property_tags))
    examples: list[DataFrame] = []
    if s.example_facts is not None and s.builtins is not None:
        known = s.exports.groupBy("name").agg(F.min("export_pos").alias("pos"))
        examples.append(findings.unknown_identifiers(s.example_facts, known, s.builtins))
    if s.examples is not None and s.example_results is not None:
        examples += [findings.runtime_failures(s.examples, s.example_results), findings.failed_assertions(s.examples, s.example_results)]
    links = [] if s.link_texts is None else [findings.broken_links(s.link_texts, registry.names(s.exports, members=s.members))]
    out = findings.lint_run(_gates(s.exports), tags, examples, links)
    return out if options.lint else out.limit(0)


def prose_lint(s: Surface) -> DataFrame:
    """Code in the documentation against the package: imports that it lacks, members that no type has, deprecated names."""
    columns = ["path", "block", "line", "type", "target"]
    out = prose.broken_imports(s.facts, registry.names(s.exports), s.package)
    if s.members is None or s.builtins is None or "return_type" not in s.exports.columns:
        return out.select(*columns)
    builders = registry.return_owner(s.exports).where("gives IS NOT NULL")
    out = out.select(*columns).unionByName(prose.unresolved_members(s.facts, s.package, registry.names(s.exports), s.members, builders, s.builtins).select(*columns))
    notes = s.exports
    for name in ("reason", "tag_text"):
        if name not in notes.columns:
            notes = notes.withColumn(name, F.lit(None).cast("string"))
    flags = s.members.select("class", "member", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))
    old = prose.deprecated_references(s.facts, s.package, registry.deprecated_exports(notes), registry.member_owners(flags), builders, flags)
    return out.unionByName(old.select(*columns))


def coverage(s: Surface, options: Options = Options()) -> DataFrame:
    out = scoring.package_coverage(s.exports, options.skip_external)
    return out.withColumn("passes", predicates.gate("score", F.lit(options.minimum)))


def coverage_all(s: Surface) -> DataFrame:
    return scoring.coverage_rollup(s.exports)


def scan(s: Surface, options: Options = Options(), pages: DataFrame | None = None) -> DataFrame:
    """Coverage, issues (of the surface and of the prose about it), health and gate of each package.

    ``pages``: the result of ``docs_map``; a page that fails holds every package back.
    """
    issues = lint(s, options).select("spec_id", "export_key")
    if s.facts is not None and options.lint:
        issues = issues.unionByName(prose_lint(s).select(F.lit(s.package).alias("spec_id"), F.lit(None).cast("string").alias("export_key")))
    out = scoring.batch_scan(scoring.package_coverage(s.exports, options.skip_external), issues, options.minimum)
    if pages is not None:
        failed = pages.where("status = 'fail'").isEmpty()
        out = out.withColumn("passes", F.col("passes") & F.lit(failed))
    return out


def health(s: Surface, options: Options = Options()) -> DataFrame:
    return scan(s, options).select("spec_id", "health", "exports", "documented", "with_issues")


def listing(s: Surface, kinds: list[str] | None = None, undocumented: bool = False, with_findings: bool = False, search: str | None = None) -> DataFrame:
    """Exports by kind, without documentation, with findings, or by likeness of the name (best first)."""
    out = s.exports
    if kinds:
        out = out.where(F.lower("kind").isin([k.lower() for k in kinds]))
    if undocumented:
        out = out.where(~predicates.documented())
    if with_findings:
        out = out.join(lint(s).select("export_key").distinct(), "export_key", "left_semi")
    if search is not None:
        out = out.withColumn("score", fuzzy.search_score(F.lit(search), "name")).where("score > 0").orderBy(F.col("score").desc(), "export_pos")
    return out


def get(s: Surface, name: str) -> DataFrame:
    return s.exports.where((F.col("name") == name) | (F.col("export_key") == name))


def suggestions(s: Surface, name: str, top: int = 3) -> DataFrame:
    return listing(s, search=name).limit(top)


def extract(s: Surface, include: DataFrame | None = None, exclude: DataFrame | None = None, visibility: list[str] | None = None) -> DataFrame:
    return predicates.select_exports(s.exports, include, exclude, visibility)


def filtered(s: Surface, kind: str | None = None, search: str | None = None, deprecated: bool | None = None, tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exports that meet all criteria, and one row: matched, total."""
    ok = F.lit(True)
    if kind:
        ok &= F.col("kind") == kind
    if search:
        ok &= F.lower("name").contains(search.lower())
    if deprecated is not None:
        ok &= F.coalesce("deprecated", F.lit(False)) == deprecated
    if tag:
        ok &= F.array_contains("tag_names", tag)
    return s.exports.where(ok), s.exports.agg(F.count_if(ok).alias("matched"), F.count("*").alias("total"))


def validate(exports: DataFrame) -> DataFrame:
    """Rows that break the shape of a surface, with what is wrong."""
    bad = [F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "name is missing"), F.when(F.col("kind").isNull() | ~F.col("kind").isin(*render.KINDS, "namespace", "map", "token", "trait", "reference"), "unknown kind"), F.when(F.col("export_key").isNull(), "no id and no name")]
    return exports.withColumn("errors", F.array_compact(F.array(*bad))).where(F.size("errors") > 0)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    return versions.spec_diff(old, new)


def breaking(old: DataFrame, new: DataFrame) -> DataFrame:
    return versions.breaking_severity(versions.spec_diff(old, new)).orderBy("rank", "id")


def semver(old: DataFrame, new: DataFrame) -> DataFrame:
    return versions.semver_bump(versions.spec_diff(old, new))


def changelog(old: DataFrame, new: DataFrame, version: str, bump: str) -> DataFrame:
    return render.changelog(versions.spec_diff(old, new), version, bump)


def docs_map(code: DataFrame, documented: DataFrame, baselines: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    return keys.page_gate(keys.key_coverage(code, documented, code.select("key"), mentions), baselines)


def docs_map_stub(documented: DataFrame, code: DataFrame) -> DataFrame:
    return keys.page_candidates(documented, code.select(F.col("page").alias("type"), "key"))


def ci(s: Surface, packages: DataFrame, changed_files: DataFrame, minimum: int) -> DataFrame:
    """Changed packages with coverage (externals count here), issues and pass; a package without exports is a row of zeros."""
    chosen = predicates.changed_packages(packages, changed_files)
    cover = scoring.package_coverage(s.exports, skip_external=False)
    issues = lint(s).groupBy("spec_id").agg(F.count("*").alias("issues"))
    out = chosen.join(cover, "spec_id", "left").join(issues, "spec_id", "left").fillna(0, ["exports", "documented", "score", "issues"])
    return out.withColumn("passes", F.col("score") >= minimum)


def release(s: Surface, minimum: int) -> DataFrame:
    return scoring.release_readiness(scoring.package_coverage(s.exports, skip_external=False), lint(s), s.exports.where(~predicates.documented()), minimum)


def report(log: DataFrame, minimum: int) -> tuple[DataFrame, DataFrame]:
    trends = history.package_trends(log)
    return trends, history.attention(trends, minimum)


def context(s: Surface, options: Options = Options()) -> DataFrame:
    return render.context_markdown(scan(s, options), s.exports.where(~predicates.documented()))


def package_context(exports: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of packages with a place: the finding's own (file, line), else that of its export."""
    own = issues.select("export_key", "type", "target", *[F.col(c).alias(f"own_{c}") if c in issues.columns else F.lit(None).cast("string" if c == "file" else "int").alias(f"own_{c}") for c in ("file", "line")])
    place = exports.select("spec_id", "export_key", "name", "source_file", "source_line")
    return own.join(place, "export_key", "left").select("spec_id", "export_key", "name", "type", "target", F.coalesce("own_file", "source_file").alias("file"), F.coalesce("own_line", "source_line").alias("line"))


def examples(exports: DataFrame, examples_: DataFrame, results: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """Presence, type errors and runs of examples."""
    return {"presence": scoring.example_presence(exports), "typecheck": scoring.example_counts(errors, examples_), "run": findings.runtime_failures(examples_, results).unionByName(findings.failed_assertions(examples_, results))}


def cache_status(files: DataFrame) -> DataFrame:
    """Entries of a cache folder read as binary files."""
    return files.agg(F.count("*").alias("entries"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.min("modificationTime").alias("oldest"), F.max("modificationTime").alias("newest"))


def snapshot(s: Surface) -> DataFrame:
    documented = s.exports.select("spec_id", predicates.documented().alias("documented"))
    return documented.groupBy("spec_id").agg(F.count("*").alias("exports"), F.count_if("documented").alias("documented")).withColumn("coverage", percent("documented", "exports"))


def init(s: Surface) -> DataFrame:
    """The minimum that a first configuration sets: five points below the worst package."""
    return scoring.initial_threshold(scoring.package_coverage(s.exports))


def config_rows(spark: SparkSession, settings: config.Config) -> DataFrame:
    """A configuration as rows (key, value)."""
    return spark.createDataFrame(config.as_rows(settings), "key string, value string")


COMMANDS = {
    "scan": scan, "health": health, "coverage": coverage, "lint": lint, "list": listing, "get": get, "extract": extract, "filter": filtered, "validate": validate, "diff": diff, "breaking": breaking, "semver": semver,
    "changelog": changelog, "docs-map": docs_map, "ci": ci, "release": release, "report": report, "context": context, "examples": examples, "cache": cache_status, "init": init, "config": config_rows,
}


def capabilities() -> list[dict[str, str]]:
    """The commands with what they do, for machines."""
    return [{"name": k, "summary": (f.__doc__ or f.__name__.replace("_", " ")).strip().split("\n")[0]} for k, f in COMMANDS.items()]


#: Commands that assistants may call by name.
TOOLS = ("extract", "list", "get", "scan", "lint", "coverage", "health", "diff", "breaking")


def call_tool(tool: str, *args, **options) -> DataFrame:
    """One JSON line: the result of a command in its envelope, or an error where there is no such tool."""
    if tool not in TOOLS:
        spark = next(x.sparkSession for x in (args[0].exports if isinstance(args[0], Surface) else args[0],))
        return render.error_envelope(spark, tool, f"no tool {tool}", not_found=True)
    return render.envelope(COMMANDS[tool](*args, **options), tool, VERSION)
