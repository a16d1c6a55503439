"""Results as text: envelopes, annotations, Markdown. Each renderer is an aggregation to a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_data, escape_property
from ..operators.predicates import side_by_side
from ..operators.versions import next_version

KINDS = ("function", "class", "interface", "type", "enum", "variable")


def envelope(df: DataFrame, command: str, version: str, duration_ms: int = 0, next_steps: list[str] | None = None) -> DataFrame:
    """One row, one JSON line: ``{ok, data, meta, next}``; ``df`` is a result of one row or a list of rows."""
    data = df.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("data"))
    fields = [F.lit(True).alias("ok"), F.col("data"), F.struct(F.lit(command).alias("command"), F.lit(duration_ms).alias("duration"), F.lit(version).alias("version")).alias("meta")]
    if next_steps:
        fields.append(F.array(*[F.lit(x) for x in next_steps]).alias("next"))
    return data.select(F.to_json(F.struct(*fields)).alias("value"))


def error_envelope(spark, command: str, message: str, not_found: bool = False) -> DataFrame:
    """An error and its exit code: 1 where something isn't found, else 2."""
    row = spark.range(1).select(F.lit(False).alias("ok"), F.struct(F.lit(message).alias("message"), F.lit(1 if not_found else 2).alias("code")).alias("error"), F.lit(command).alias("command"))
    return row.select(F.to_json(F.struct("ok", "error", "command")).alias("value"))


def annotations(findings: DataFrame, level: str = "warning") -> DataFrame:
    """CI annotation lines of findings (file, line, message)."""
    place = F.concat_ws(",", F.concat(F.lit("file="), escape_property(F.regexp_replace("file", r"^\./", ""))), F.concat(F.lit("line="), F.col("line").cast("string")))
    return findings.select(F.concat(F.lit(f"::{level} "), place, F.lit("::"), escape_data("message")).alias("value"))


def _listed(text: Column, *order: Column | str) -> Column:
    """Lines of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], text.alias("__text")))), lambda s: s["__text"]), "\n")


def surface_markdown(exports: DataFrame) -> DataFrame:
    """A document for each spec: exports by kind in a fixed order, then by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0)), F.lit(len(KINDS) + 1))
    line = F.concat(F.lit("- `"), F.col("name"), F.lit("`"), F.when(F.length(F.trim("description")) > 0, F.concat(F.lit(": "), F.trim("description"))).otherwise(F.lit("")))
    kinds = exports.withColumn("rank", rank).groupBy("spec_id", "rank", "kind").agg(_listed(line, "name", "export_key").alias("body"))
    kinds = kinds.withColumn("part", F.concat(F.lit("## "), F.initcap("kind"), F.lit("\n\n"), F.col("body")))
    return kinds.groupBy("spec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "part"))), lambda s: s["part"]), "\n\n").alias("body")).select("spec_id", F.concat(F.lit("# "), F.col("spec_id"), F.lit("\n\n"), F.col("body")).alias("value"))


def changelog(diff: DataFrame, version: str, bump: Column | str) -> DataFrame:
    """Markdown with a section for each kind of change that occurs."""
    b = F.lit(bump) if isinstance(bump, str) else bump
    parts = diff.groupBy("change").agg(_listed(F.concat(F.lit("- "), F.col("id")), "id").alias("body"))
    titles = {"breaking": "Breaking", "added": "Added", "docs-only": "Documentation"}
    row = parts.agg(*[F.max(F.when(F.col("change") == k, F.concat(F.lit(f"### {t}\n\n"), F.col("body")))).alias(k) for k, t in titles.items()])
    return row.select(F.concat_ws("\n\n", F.concat(F.lit("## "), next_version(F.lit(version), b)), *[F.col(f"`{k}`") for k in titles]).alias("value"))


def pull_request_comment(packages: DataFrame, breaking: DataFrame, marker: str = "<!-- documentation report -->") -> DataFrame:
    """Body of a review comment: a table of packages (spec_id, score, issues, passes) and the breaking changes."""
    row = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("spec_id")), F.concat(F.col("score").cast("string"), F.lit("%")), F.col("issues").cast("string"), F.concat(F.when(F.col("passes"), "ok").otherwise("below minimum"), F.lit(" |")))
    table = packages.agg(_listed(row, "spec_id").alias("rows"))
    changes = breaking.agg(_listed(F.concat(F.lit("- "), F.col("id"), F.lit(" ("), F.col("severity"), F.lit(")")), "rank", "id").alias("changes"))
    head = "| Package | Coverage | Issues | State |\n|---|---|---|---|\n"
    return side_by_side(table, changes).select(F.concat(F.lit(marker + "\n" + head), F.col("rows"), F.when(F.length("changes") > 0, F.concat(F.lit("\n\n### Breaking\n\n"), F.col("changes"))).otherwise(F.lit(""))).alias("value"))


def context_markdown(packages: DataFrame, undocumented: DataFrame, worst: int = 3, listed: int = 10) -> DataFrame:
    """A page for assistants: packages, those with most issues, undocumented names."""
    table = packages.agg(_listed(F.concat(F.lit("| "), F.col("spec_id"), F.lit(" | "), F.col("score").cast("string"), F.lit("% | "), F.col("issues").cast("string"), F.lit(" |")), "spec_id").alias("packages"))
    top = packages.orderBy(F.col("issues").desc(), "spec_id").limit(worst).agg(_listed(F.concat(F.lit("- "), F.col("spec_id"), F.lit(": "), F.col("issues").cast("string"), F.lit(" issues")), (-F.col("issues")).alias("__n"), "spec_id").alias("attention"))
    names = undocumented.orderBy("name", "export_key").limit(listed).agg(_listed(F.concat(F.lit("- "), F.col("name")), "name", "export_key").alias("names"))
    return side_by_side(table, top, names).select(F.concat(F.lit("# Documentation state\n\n| Package | Coverage | Issues |\n|---|---|---|\n"), F.col("packages"), F.lit("\n\n## Attention\n\n"), F.col("attention"), F.lit("\n\n## Undocumented\n\n"), F.col("names")).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def write_spec(exports: DataFrame, path: str) -> None:
    """Exports as one JSON document, and file, for each spec."""
    inner = [c for c in exports.columns if c != "spec_id"]
    order = F.array_sort(F.collect_list(F.struct("export_pos", *[c for c in inner if c != "export_pos"])))
    exports.groupBy("spec_id").agg(order.alias("exports")).select(F.struct(F.col("spec_id").alias("name")).alias("meta"), "exports").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def package_list(packages: DataFrame, most: int = 10) -> DataFrame:
    """The first public packages (name, private) by name, and a line with how many more there are."""
    public = packages.where(~F.coalesce("private", F.lit(False)))
    total = public.agg(F.count("*").alias("n"))
    first = public.orderBy(F.collate("name", "UNICODE")).limit(most).agg(_listed(F.concat(F.lit("- "), F.col("name")), "name").alias("first"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n… and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return side_by_side(total, first).select(F.concat(F.col("first"), more).alias("value"))


def signatures(params: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """Text of each signature (export_key, sig_pos, signature): ``(a: T, b?: U): R``, with ``void`` where nothing is returned.

    ``params``: export_key, sig_pos, param_pos, name, type, required and, if there are any, rest.
    """
    rest = F.when(F.coalesce(F.col("rest"), F.lit(False)), "...").otherwise("") if "rest" in params.columns else F.lit("")
    one = F.concat(rest, "name", F.when(F.col("required") == F.lit(False), "?").otherwise(""), F.lit(": "), F.coalesce("type", F.lit("unknown")))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("param_pos", one.alias("text")))), lambda s: s["text"]), ", ")
    out = params.groupBy("export_key", "sig_pos").agg(inner.alias("inner"))
    result = F.lit("void")
    if returns is not None:
        out = out.join(returns.select("export_key", "actual_type"), "export_key", "left")
        result = F.coalesce("actual_type", F.lit("void"))
    return out.select("export_key", "sig_pos", F.concat(F.lit("("), F.col("inner"), F.lit("): "), result).alias("signature"))


def declaration(kind: Column | str = "kind", name: Column | str = "name", type_: Column | str = "type", base: Column | str = "base") -> Column:
    """One line that declares an export, by its kind; functions are followed by their signature."""
    k, n, t, b = (F.col(c) if isinstance(c, str) else c for c in (kind, name, type_, base))
    known = F.coalesce(t, F.when(k.isin("interface", "type"), F.lit("{ ... }")).otherwise(F.lit("unknown")))
    parent = F.when(b.isNotNull(), F.concat(F.lit(" extends "), b)).otherwise(F.lit(""))
    return (
        F.when(k == "class", F.concat(F.lit("class "), n, parent))
        .when(k.isin("interface", "type"), F.concat(F.lit("type "), n, F.lit(" = "), known))
        .when(k == "variable", F.concat(F.lit("const "), n, F.lit(": "), known))
        .when(k == "enum", F.concat(F.lit("enum "), n, F.lit(" { ... }")))
        .when(k == "function", F.concat(F.lit("function "), n, F.coalesce(t, F.lit("(): unknown"))))
        .otherwise(F.concat(k, F.lit(" "), n))
    )


def display_params(params: DataFrame) -> DataFrame:
    """Parameters of the first signature as people read them: name, type, whether it may be left out."""
    first = params.groupBy("export_key").agg(F.min("sig_pos").alias("sig_pos"))
    return params.join(first, ["export_key", "sig_pos"]).select("export_key", "param_pos", "name", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce(~F.col("required"), F.lit(False)).alias("optional"))
