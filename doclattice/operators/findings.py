"""Detectors: documented facts against actual ones, each a join that yields findings.

All of them return (export_key, type, target, expected, actual, suggestion), so their union
keeps one shape; ``all_findings`` adds the order of the detectors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import assertions, braces_type, error_line, has_plain_comment, is_promise, lines, link_targets, normalize_type, present, same_type, trim, truthy, types_equivalent
from .fuzzy import closest
from .predicates import first_wins, last_wins

COLUMNS = ["export_key", "type", "target", "expected", "actual", "suggestion"]


def _finding(df: DataFrame, kind: str, target: Column, expected: Column | None = None, actual: Column | None = None, suggestion: Column | None = None) -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return df.select("export_key", F.lit(kind).alias("type"), text(target).alias("target"), text(expected).alias("expected"), text(actual).alias("actual"), text(suggestion).alias("suggestion"))


def param_names(params: DataFrame, doc_params: DataFrame, suggest: bool = False) -> DataFrame:
    """Documented parameters that no overload has; ``a.b`` is checked by ``a``.

    ``params`` may have ``properties`` (array): then a dotted name's property must be one of them
    unless the array is empty or null.
    """
    head = F.substring_index("name", ".", 1)
    docs = doc_params.select("export_key", "tag_pos", "name", head.alias("head"), F.when(F.contains("name", F.lit(".")), F.substring_index(F.expr("substring(name, length(substring_index(name, '.', 1)) + 2)"), ".", 1)).alias("prop"))
    known = params.select("export_key", F.col("name").alias("head")).distinct()
    lost = docs.join(known, ["export_key", "head"], "left_anti").select("export_key", "tag_pos", "name")
    if "properties" in params.columns:
        props = params.where(F.size("properties") > 0).select("export_key", F.col("name").alias("head"), F.explode("properties").alias("prop")).distinct()
        closed = props.select("export_key", "head").distinct()
        wrong = docs.where("prop IS NOT NULL").join(closed, ["export_key", "head"], "left_semi").join(props, ["export_key", "head", "prop"], "left_anti").select("export_key", "tag_pos", "name")
        lost = lost.unionByName(wrong)
    if not suggest:
        return _finding(lost, "param-mismatch", F.col("name"))
    have = params.select("export_key", "name", "param_pos").groupBy("export_key", "name").agg(F.min("param_pos").alias("pos"))
    near = closest(lost.select("export_key", F.col("name").alias("source")).distinct(), have.withColumnRenamed("name", "candidate"), by=["export_key"])
    return _finding(lost.join(near.select("export_key", F.col("source").alias("name"), "candidate"), ["export_key", "name"], "left"), "param-mismatch", F.col("name"), suggestion=F.col("candidate"))


def optionality(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """Parameters that are optional on one side only; the first overload that has the name decides."""
    first = first_wins(params, ["export_key", "name"], "sig_pos", "param_pos").select("export_key", "name", F.coalesce(~F.col("required"), F.lit(False)).alias("is_optional"))
    bad = doc_params.join(first, ["export_key", "name"]).where(F.col("optional") != F.col("is_optional"))
    say = lambda c: F.when(c, "optional").otherwise("required")
    return _finding(bad, "optionality-mismatch", F.col("name"), say(F.col("is_optional")), say(F.col("optional")))


def param_types(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """Documented types that differ from the first declared one."""
    first = first_wins(params.where("type IS NOT NULL"), ["export_key", "name"], "sig_pos", "param_pos").select("export_key", "name", F.col("type").alias("declared"))
    bad = doc_params.where(present("type")).join(first, ["export_key", "name"]).where(~types_equivalent("type", "declared"))
    return _finding(bad, "param-type-mismatch", F.col("name"), normalize_type("declared"), normalize_type("type"))


#: The types of ``parameters``, in the order of their detectors.
PARAMETERS = ["param-mismatch", "optionality-mismatch", "param-type-mismatch"]


def parameters(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """What ``param_names``, ``optionality`` and ``param_types`` find, by one join of both tables.

    Properties of parameters have tables of their own, so with them each detector runs by itself.
    """
    if "properties" in params.columns:
        return param_names(params, doc_params).unionByName(optionality(params, doc_params)).unionByName(param_types(params, doc_params))
    own = Window.partitionBy("export_key", "name").orderBy("sig_pos", "param_pos")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = params.select("export_key", "name", "required", F.first("type", ignorenulls=True).over(whole).alias("declared"), F.row_number().over(own).alias("__n")).where("__n = 1")
    first = first.select("export_key", F.col("name").alias("key"), F.coalesce(~F.col("required"), F.lit(False)).alias("is_optional"), normalize_type("declared").alias("declared"), F.lit(True).alias("known"))
    # a dotted name is looked up by its head, and as it is
    head = F.substring_index("name", ".", 1)
    keys = F.when(F.contains("name", F.lit(".")), F.array(head, "name")).otherwise(F.array("name"))
    asked = doc_params.select("export_key", "name", F.when(present("type"), normalize_type("type")).alias("type"), "optional", head.alias("head"), F.explode(keys).alias("key"))
    both = asked.join(first, ["export_key", "key"], "left")
    say = lambda c: F.when(c, "optional").otherwise("required")
    entry = lambda kind, when, expected=None, actual=None: F.when(when, F.struct(F.lit(kind).alias("type"), F.col("name").alias("target"), (F.lit(None).cast("string") if expected is None else expected).alias("expected"), (F.lit(None).cast("string") if actual is None else actual).alias("actual")))
    exact = F.col("known") & (F.col("key") == F.col("name"))
    found = [
        entry(PARAMETERS[0], F.col("known").isNull() & F.col("key").eqNullSafe(F.col("head"))),
        entry(PARAMETERS[1], exact & (F.col("optional") != F.col("is_optional")), say(F.col("is_optional")), say(F.col("optional"))),
        entry(PARAMETERS[2], exact & F.col("declared").isNotNull() & F.col("type").isNotNull() & ~same_type(F.col("type"), F.col("declared")), F.col("declared"), F.col("type")),
    ]
    out = both.select("export_key", F.explode(F.array(*found)).alias("f")).where("f IS NOT NULL")
    return out.select("export_key", "f.*", F.lit(None).cast("string").alias("suggestion"))


def return_types(returns: DataFrame) -> DataFrame:
    """Rows (export_key, actual_type, doc_type): documented return types that differ."""
    bad = returns.where(present("doc_type") & present("actual_type") & ~types_equivalent("doc_type", "actual_type"))
    hint = F.when(is_promise("actual_type") & ~is_promise("doc_type"), "the value is wrapped in a promise").when(~is_promise("actual_type") & is_promise("doc_type"), "the value isn't wrapped in a promise")
    return _finding(bad, "return-type-mismatch", F.lit("returns"), normalize_type("actual_type"), normalize_type("doc_type"), hint)


def generic_constraints(actual: DataFrame, doc: DataFrame) -> DataFrame:
    """Type parameters (export_key, pos, name, constraint) whose documented constraint differs; missing on both sides is equal."""
    first = first_wins(actual, ["export_key", "name"], "pos").select("export_key", "name", F.col("constraint").alias("declared"))
    bad = doc.join(first, ["export_key", "name"]).where(~F.col("constraint").eqNullSafe(F.col("declared")))
    return _finding(bad, "generic-constraint-mismatch", F.col("name"), F.col("declared"), F.col("constraint"))


def property_types(members: DataFrame) -> DataFrame:
    """Properties (export_key, name, type, tag_text) whose ``{T}`` tag names another type."""
    bad = members.withColumn("tagged", braces_type("tag_text")).where(present("tagged") & present("type") & ~types_equivalent("tagged", "type"))
    return _finding(bad, "property-type-mismatch", F.col("name"), F.col("type"), F.col("tagged"))


def deprecation(exports: DataFrame) -> DataFrame:
    """Deprecated in code or in a tag, but not in both."""
    bad = exports.where(F.coalesce("deprecated", F.lit(False)) != F.coalesce("tag_deprecated", F.lit(False)))
    say = lambda c: F.when(F.coalesce(c, F.lit(False)), "deprecated").otherwise("current")
    return _finding(bad, "deprecated-mismatch", F.col("name"), say(F.col("deprecated")), say(F.col("tag_deprecated")))


def visibility(items: DataFrame) -> DataFrame:
    """Rows (export_key, target, tag_names, actual): the first visibility tag against the code's visibility (public if null)."""
    tag = F.try_element_at(F.filter("tag_names", lambda t: t.isin("public", "protected", "private", "internal", "alpha")), F.lit(1))
    doc = F.when(tag.isin("internal", "alpha"), "internal").otherwise(tag)
    code = F.coalesce("actual", F.lit("public"))
    same = F.when(doc == "internal", code != "public").otherwise(doc == code)
    bad = items.withColumns({"doc": doc, "code": code}).where(F.col("doc").isNotNull() & ~same)
    return _finding(bad, "visibility-mismatch", F.col("target"), F.col("code"), F.col("doc"))


def asynchrony(returns: DataFrame) -> DataFrame:
    """A promise that isn't documented, or a documented one that no overload gives."""
    code = is_promise("actual_type")
    doc = F.coalesce(F.lower("doc_type").contains("promise"), F.lit(False)) | F.coalesce("async_tag", F.lit(False))
    bad = returns.withColumns({"code": code, "doc": doc}).where((F.col("code") & ~F.col("doc") & F.col("doc_type").isNotNull()) | (~F.col("code") & F.col("doc") & ~F.coalesce("async_flag", F.lit(False))))
    say = lambda c: F.when(c, "async").otherwise("sync")
    return _finding(bad, "async-mismatch", F.lit("returns"), say(F.col("code")), say(F.col("doc")))


def broken_links(texts: DataFrame, names: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Link targets of (export_key, text) that neither the registry (name) nor another module knows.

    Code in backticks is no text; addresses, paths and package names are no targets.
    """
    plain = F.regexp_replace(F.regexp_replace("text", "(?s)```.*?```", " "), "`[^`]*`", " ")
    # outer, as the optimizer else finds the targets twice: also for a filter of texts that have any
    target = texts.select("export_key", F.explode_outer(link_targets(plain)).alias("target")).where("target IS NOT NULL")
    target = target.where(~F.col("target").rlike(r"^(?:[a-z]+:)?//|^[./@#]|^mailto:")).withColumn("root", F.regexp_extract("target", r"^[^.#~]+", 0))
    known = names.select(F.col("name").alias("root")).distinct()
    if modules is not None:
        known = known.unionByName(modules.select(F.col("name").alias("root"))).distinct()
    lost = target.join(known, "root", "left_anti").join(known.withColumnRenamed("root", "target"), "target", "left_anti")
    return _finding(lost, "broken-link", F.col("target"))


# -- examples


def runtime_failures(examples: DataFrame, results: DataFrame) -> DataFrame:
    """Examples (export_key, ex_pos) whose run (success, stderr, exit_code) failed."""
    bad = examples.select("export_key", "ex_pos").join(results.where("NOT success"), ["export_key", "ex_pos"])
    late = F.lower("stderr").contains("timed out") | F.lower("stderr").contains("timeout")
    return _finding(bad, "example-runtime", F.concat(F.lit("example "), F.col("ex_pos").cast("string")), actual=F.when(late, "timeout").otherwise(error_line("stderr")))


def example_positions(examples: DataFrame) -> DataFrame:
    """Adds ``index``, the place of an example among those of its surface (spec_id, export_pos, ex_pos), from 0."""
    return examples.withColumn("index", F.row_number().over(Window.partitionBy("spec_id").orderBy("export_pos", "ex_pos")) - 1)


def placed_errors(errors: DataFrame, examples: DataFrame) -> DataFrame:
    """Errors by the place of their example (spec_id, index) with the export; of exports with one name the first stands for all."""
    first = examples.groupBy("spec_id", "name").agg(F.min_by("export_key", "export_pos").alias("export_key"))
    return errors.join(example_positions(examples).select("spec_id", "index", "name", "ex_pos"), ["spec_id", "index"]).join(first, ["spec_id", "name"])


def string_examples(examples: DataFrame) -> DataFrame:
    """Code of each example (export_key, examples as JSON texts): a text, or the code of an object; others are left out."""
    code = lambda x: F.when(x.startswith('"'), F.from_json(F.concat(F.lit('{"c":'), x, F.lit("}")), "c string")["c"]).otherwise(F.get_json_object(x, "$.code"))
    return examples.select("export_key", F.posexplode(F.filter(F.transform("examples", code), lambda v: v.isNotNull())).alias("ex_pos", "code"))


def failed_assertions(examples: DataFrame, results: DataFrame, parser: Callable[[Column], Column] | None = None) -> DataFrame:
    """The j-th ``// =>`` comment of an example against the j-th non-blank line that its run printed.

    ``parser`` gives an array of (line, expected) for examples that have comments but none of that form.
    """
    read = assertions("code")
    if parser is not None:
        read = F.when((F.size(read) == 0) & has_plain_comment("code"), parser(F.col("code"))).otherwise(read)
    said = examples.select("export_key", "ex_pos", F.posexplode(read).alias("j", "a")).select("export_key", "ex_pos", "j", F.col("a.expected").alias("expected"), F.col("a.line").alias("line"))
    out = results.where("success").select("export_key", "ex_pos", F.posexplode(F.filter(F.transform(lines("stdout"), trim), lambda v: v != "")).alias("j", "actual"))
    ran = results.where("success").select("export_key", "ex_pos")
    bad = said.join(ran, ["export_key", "ex_pos"], "left_semi").join(out, ["export_key", "ex_pos", "j"], "left").where("actual IS NULL OR actual <> expected")
    return _finding(bad, "example-assertion", F.concat(F.lit("line "), F.col("line").cast("string")), F.col("expected"), F.col("actual"))


def unknown_identifiers(facts: DataFrame, names: DataFrame, builtins: DataFrame) -> DataFrame:
    """Identifiers of examples (export_key, name, is_local) that nothing declares; Pascal-case ones are reported, others if a known name is near."""
    free = facts.where((F.length("name") > 1) & ~F.col("is_local")).select("export_key", "name").distinct()
    free = free.join(names.select("name"), "name", "left_anti").join(builtins.select("name"), "name", "left_anti")
    near = closest(free.select(F.col("name").alias("source")).distinct(), names.select(F.col("name").alias("candidate"), F.col("pos")))
    hit = free.join(near.withColumnRenamed("source", "name"), "name", "left").where(F.col("name").rlike("^[A-Z][a-z]") | (F.col("distance") <= 5))
    return _finding(hit, "example-identifier", F.col("name"), suggestion=F.col("candidate"))


# -- all together


def all_findings(exports: DataFrame, parts: list[DataFrame], gated: bool = True) -> DataFrame:
    """Union of the detectors' results in their order, for exports with a description, tags or examples, with place of the export."""
    empty = parts[0].limit(0).withColumn("detector", F.lit(0))
    out = reduce(lambda a, b: a.unionByName(b), [p.withColumn("detector", F.lit(k)) for k, p in enumerate(parts)], empty)
    kept = exports.where(present("description") | F.coalesce("has_tags", F.lit(False)) | F.coalesce("has_example", F.lit(False))) if gated and "has_tags" in exports.columns else exports
    return out.join(kept.select("spec_id", "export_key", F.col("source_file").alias("file"), F.col("source_line").alias("line")), "export_key")


def near_deprecation(findings: DataFrame, doc_lines: DataFrame, reach: int = 5) -> DataFrame:
    """Findings (path, start, end) without a line about deprecation within ``reach`` lines.

    The range condition is an equi-join on buckets of lines, so no pair of a file is formed
    that lies further apart than two buckets.
    """
    width = max(16, 2 * reach)
    marks = doc_lines.where(F.lower("text").contains("deprecat")).select("path", "line", F.floor(F.col("line") / width).alias("bucket"))
    spread = findings.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - reach) / width), F.floor((F.col("end") + reach) / width))))
    near = spread.join(marks, ["path", "bucket"]).where(F.col("line").between(F.col("start") - reach, F.col("end") + reach)).select("path", "start", "end").distinct()
    return findings.join(near, ["path", "start", "end"], "left_anti")


def lint_run(exports: DataFrame, by_tags: list[DataFrame | tuple[DataFrame, list[str]]], by_examples: list[DataFrame], by_text: list[DataFrame]) -> DataFrame:
    """Every detector over whole surfaces: each runs for the exports that have what it reads.

    ``by_tags`` run where an export has tags, ``by_examples`` where it has examples, ``by_text``
    where it has a description (blank or not) or tags. The numbers of the detectors follow this
    order; a pair of findings and their types stands for a detector of each type. Of exports
    with one key the last counts.
    """
    last = last_wins(exports, ["spec_id", "export_key"], "export_pos")
    tags, examples = F.coalesce("has_tags", F.lit(False)), F.coalesce("has_example", F.lit(False))
    last = last.select("spec_id", "export_key", F.col("source_file").alias("file"), F.col("source_line").alias("line"), tags.alias("__tags"), examples.alias("__examples"), (truthy("description") | tags).alias("__text"))
    gates = ["__tags"] * len(by_tags) + ["__examples"] * len(by_examples) + ["__text"] * len(by_text)
    parts, n = [], 0
    for p, g in zip([*by_tags, *by_examples, *by_text], gates):
        p, kinds = p if isinstance(p, tuple) else (p, [None])
        number = F.lit(n) if len(kinds) == 1 else F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("type")).cast("int") + F.lit(n - 1)
        parts.append(p.withColumns({"detector": number, "gate": F.lit(g)}))
        n += len(kinds)
    out = reduce(lambda a, b: a.unionByName(b), parts).join(last, "export_key")
    passed = F.when(F.col("gate") == "__tags", F.col("__tags")).when(F.col("gate") == "__examples", F.col("__examples")).otherwise(F.col("__text"))
    return out.where(passed).drop("gate", "__tags", "__examples", "__text")


def with_issue(findings: DataFrame) -> DataFrame:
    """Adds ``issue``, what a finding says to its reader."""
    t, q = F.col("type"), F.concat(F.lit("`"), F.col("target"), F.lit("`"))
    none = F.lit("nothing")
    e, a = F.coalesce("expected", none), F.coalesce("actual", none)
    says = {
        "param-mismatch": F.concat(q, F.lit(" is documented, but no signature has it")),
        "optionality-mismatch": F.concat(q, F.lit(" is documented as "), a, F.lit(", declared as "), e),
        "param-type-mismatch": F.concat(q, F.lit(" is documented with type "), a, F.lit(", declared with "), e),
        "return-type-mismatch": F.concat(F.lit("the documented result is "), a, F.lit(", the declared one "), e),
        "generic-constraint-mismatch": F.when(F.col("expected").isNull(), F.concat(q, F.lit(" is constrained by its tag alone, to "), a)).when(F.col("actual").isNull(), F.concat(q, F.lit(" lacks its constraint, "), e)).otherwise(F.concat(q, F.lit(" is constrained to "), a, F.lit(", declared with "), e)),
        "property-type-mismatch": F.concat(q, F.lit(" is tagged "), a, F.lit(", declared "), e),
        "deprecated-mismatch": F.concat(q, F.lit(" is "), e, F.lit(" in code, "), a, F.lit(" in its tags")),
        "visibility-mismatch": F.concat(q, F.lit(" is "), e, F.lit(" in code, "), a, F.lit(" in its tags")),
        "async-mismatch": F.concat(F.lit("the code is "), e, F.lit(", its documentation "), a),
        "broken-link": F.concat(q, F.lit(" leads nowhere")),
        "example-runtime": F.concat(q, F.lit(" failed: "), a),
        "example-assertion": F.when(F.col("actual").isNull(), F.concat(q, F.lit(" expects "), e, F.lit(" and there was no output"))).otherwise(F.concat(q, F.lit(" expects "), e, F.lit(", not "), a)),
        "example-identifier": F.concat(q, F.lit(" isn't known")),
    }
    text = None
    for kind, x in says.items():
        text = F.when(t == kind, x) if text is None else text.when(t == kind, x)
    hint = F.when(F.col("suggestion").isNotNull(), F.concat(F.lit(" ("), F.col("suggestion"), F.lit(")"))).otherwise(F.lit(""))
    return findings.withColumn("issue", F.concat(text.otherwise(q), hint))
