"""Queries of the catalogue over whole runs: lint, prose, examples, lists, version reports, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from .catalogue import _CLOSE, _DIFF, _DOC, _FIRST, _NULLS, _PACKAGES, _RAW, _key_tables, _KEYS, _packages, _PCT, _versions, queries, query, spread, table
from .functions import scalars as S
from .operators import findings, fuzzy, history, keys, predicates, prose, registry, scoring, validation, versions
from .plans.surface import derive
from .sinks import render
from .sources import code_facts

_TAGGED, _EXAMPLE = "size % 5 <> 2", "size % 6 <> 0"


def _rows(spark, ddl: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


# -- the whole lint run

_PARTS = ["param_name_mismatch", "optionality_mismatch", "param_type_mismatch", "return_type_mismatch", "generic_constraint_mismatch", "deprecated_mismatch", "visibility_mismatch", "async_mismatch"]


def _run(spark, sf) -> DataFrame:
    e = derive(spark, sf, "exports").withColumns({"has_tags": F.expr(_TAGGED), "has_example": F.expr(_EXAMPLE)})
    tags = [(findings.parameters(derive(spark, sf, "params"), derive(spark, sf, "doc_params")), findings.PARAMETERS)]
    tags += [queries()[name](spark, sf) for name in _PARTS[len(findings.PARAMETERS) :]]
    tags.append(findings.property_types(e.select("export_key", F.lit("field").alias("name"), F.when(F.col("size") % 2 == 0, "string").otherwise("number").alias("type"), F.lit("{number} text").alias("tag_text"))))
    facts = spread(e).select("export_key", F.when(F.col("size") % 4 == 0, "Zzmissing").when(F.col("size") % 4 == 1, "qqqqq").otherwise(F.col("name")).alias("name"), F.lit(False).alias("is_local"))
    names = e.groupBy("name").agg(F.min("export_pos").alias("pos"))
    examples = [findings.unknown_identifiers(facts, names, _rows(spark, "name string", ("Promise",)))]
    links = spread(e).select("export_key", F.concat(F.lit("see {@link "), F.col("name"), F.when(F.col("size") % 3 == 0, "Gone").otherwise(""), F.lit("} and `{@link Code}`")).alias("text"))
    return findings.lint_run(e, tags, examples, [findings.broken_links(links, registry.names(e))])


def _run_sql() -> str:
    parts = [f"SELECT {k} AS detector, 'tags' AS gate, export_key, type, target FROM ({_RAW[name][0]}) p{k}" for k, name in enumerate(_PARTS)]
    parts.append("SELECT 8, 'tags', export_key, 'property-type-mismatch', 'field' FROM exports WHERE size % 2 = 0")
    parts.append("SELECT 9, 'examples', export_key, 'example-identifier', 'Zzmissing' FROM exports WHERE size % 4 = 0")
    parts.append("SELECT 10, 'text', export_key, 'broken-link', concat(name, 'Gone') FROM exports WHERE size % 3 = 0")
    return f"""WITH d AS ({' UNION ALL '.join(parts)}),
lint AS (SELECT e.spec_id, d.export_key, d.type, d.target, d.detector, e.source_file AS file, e.source_line AS line FROM d JOIN exports e USING (export_key)
WHERE CASE gate WHEN 'tags' THEN {_TAGGED} WHEN 'examples' THEN {_EXAMPLE} ELSE {_TAGGED} OR coalesce(length(description) > 0, false) END)"""


_SURFACE = ("exports", "params", "doc_params", "returns")


@query("all_findings", _run_sql() + " SELECT * FROM lint", *_SURFACE)
def _(spark, sf):
    return _run(spark, sf).select("spec_id", "export_key", "type", "target", "detector", "file", "line")


@query("issue_category_pivot", _run_sql() + """, x AS (SELECT spec_id, type FROM lint UNION ALL SELECT spec_id, 'prose-import' FROM exports WHERE size % 10 = 0)
SELECT spec_id, count(*) FILTER (type LIKE 'example-%') AS example, count(*) FILTER (type LIKE 'prose-%') AS prose, count(*) FILTER (type IN ('broken-link', 'deprecated-mismatch', 'visibility-mismatch')) AS semantic,
count(*) FILTER (type NOT LIKE 'example-%' AND type NOT LIKE 'prose-%' AND type NOT IN ('broken-link', 'deprecated-mismatch', 'visibility-mismatch')) AS structural, count(*) AS total FROM x GROUP BY spec_id""", *_SURFACE)
def _(spark, sf):
    e = derive(spark, sf, "exports")
    facts = e.select(F.col("spec_id").alias("path"), F.lit(1).alias("block"), F.lit("import").alias("fact"), F.concat("name", F.when(F.col("size") % 10 == 0, "Gone").otherwise("")).alias("name"), F.lit("pkg/sub").alias("module"), F.lit("named").alias("kind"), F.lit(1).alias("line"))
    pages = prose.broken_imports(facts, registry.names(e), "pkg").select(F.col("path").alias("spec_id"), "type")
    return scoring.issue_pivot(_run(spark, sf).select("spec_id", "type").unionByName(pages))


@query("lint_batch", _run_sql() + ", c AS (SELECT spec_id, count(*) AS issues, count(DISTINCT export_key) AS with_issues FROM lint GROUP BY ROLLUP (spec_id)) SELECT * FROM c", *_SURFACE)
def _(spark, sf):
    return _run(spark, sf).rollup("spec_id").agg(F.count("*").alias("issues"), F.count_distinct("export_key").alias("with_issues"))


@query("lint_narrowed", _run_sql() + " SELECT type, target, CASE WHEN type LIKE 'example-%' THEN 'example' WHEN type IN ('broken-link', 'deprecated-mismatch', 'visibility-mismatch') THEN 'semantic' ELSE 'structural' END AS category, spec_id FROM lint WHERE type LIKE 'example-%' OR type = 'broken-link'", *_SURFACE)
def _(spark, sf):
    run = _run(spark, sf).where("type LIKE 'example-%' OR type = 'broken-link'")
    return run.select("type", "target", predicates.category("type").alias("category"), "spec_id")


@query("issue_texts", """WITH i AS (SELECT export_key, name, size, CASE WHEN deprecated THEN 'deprecated' ELSE 'current' END AS c, CASE WHEN tag_deprecated THEN 'deprecated' ELSE 'current' END AS d FROM exports)
SELECT export_key, CASE size % 5 WHEN 0 THEN concat('`', name, '` is ', c, ' in code, ', d, ' in its tags (look)') WHEN 1 THEN concat('`', name, '` is documented, but no signature has it (look)') WHEN 2 THEN concat('`', name, '` leads nowhere')
WHEN 3 THEN concat('`', name, '` lacks its constraint, ', c) ELSE concat('`', name, '` expects ', c, ', not ', d) END AS issue FROM i""", "exports")
def _(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("deprecated-mismatch", "param-mismatch", "broken-link", "generic-constraint-mismatch", "example-assertion")])
    say = lambda c: F.when(F.col(c), "deprecated").otherwise("current")
    e = derive(spark, sf, "exports").select("export_key", F.element_at(kinds, F.col("size") % 5 + 1).alias("type"), F.col("name").alias("target"), say("deprecated").alias("expected"), F.when(F.col("size") % 5 != 3, say("tag_deprecated")).alias("actual"), F.when(F.col("size") % 5 < 2, "look").alias("suggestion"))
    return findings.with_issue(e).select("export_key", "issue")


@query("scan_whole", _run_sql() + f""", i AS (SELECT spec_id, export_key FROM lint WHERE detector NOT IN (9) UNION ALL SELECT 'Brand#1', NULL FROM exports WHERE size % 10 = 0),
c AS (SELECT spec_id, count(*) AS exports, count(*) FILTER ({_DOC}) AS documented FROM exports WHERE NOT (source_package IS NOT NULL AND source_file IS NULL) GROUP BY 1), n AS (SELECT spec_id, count(*) AS issues, count(DISTINCT export_key) AS with_issues FROM i GROUP BY 1)
SELECT c.spec_id, exports, documented, CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT) AS score, coalesce(issues, 0) AS issues, coalesce(with_issues, 0) AS with_issues,
CAST(floor(0.5::DOUBLE * CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT) + 0.5::DOUBLE * CASE WHEN documented > 0 THEN CAST(floor(100.0::DOUBLE * greatest(0, documented - coalesce(with_issues, 0)) / documented + 0.5) AS INT) ELSE 100 END + 0.5) AS INT) AS health, false AS passes FROM c LEFT JOIN n USING (spec_id)""", *_SURFACE)
def _(spark, sf):
    """A scan of whole packages: all detectors, code in prose, and a docs map with a failing page."""
    e = derive(spark, sf, "exports").withColumns({"has_tags": F.expr(_TAGGED), "has_example": F.expr(_EXAMPLE)})
    tag = F.when(F.col("size") % 5 == 0, "internal").when(F.col("size") % 5 == 1, "public").when(F.col("size") % 5 == 2, "private").when(F.col("size") % 5 == 3, "alpha")
    a = e.select("export_key", F.lit(1).alias("pos"), F.concat(F.lit("T"), (F.col("size") % 5).cast("string")).alias("name"), F.when(F.col("size") % 3 != 0, F.concat(F.lit("C"), (F.col("size") % 4).cast("string"))).alias("constraint"))
    facts = e.select(F.col("export_key").alias("path"), F.lit(1).alias("block"), F.lit("import").alias("fact"), F.concat("name", F.when(F.col("size") % 10 == 0, "Gone").otherwise("")).alias("name"), F.lit("Brand#1").alias("module"), F.lit("named").alias("kind"), F.lit(1).alias("line"))
    s = api.Surface(
        e, derive(spark, sf, "params"), derive(spark, sf, "doc_params"), derive(spark, sf, "returns"), facts=facts, package="Brand#1",
        visibility=e.select("export_key", F.col("name").alias("target"), F.array_compact(F.array(F.lit("see"), tag)).alias("tag_names"), F.when(F.col("size") % 7 < 3, "private").alias("actual")),
        link_texts=e.select("export_key", F.concat(F.lit("see {@link "), F.col("name"), F.when(F.col("size") % 3 == 0, "Gone").otherwise(""), F.lit("}")).alias("text")),
        type_params=a, doc_type_params=a.withColumn("constraint", F.when(F.substring("export_key", -1, 1).isin("1", "3"), F.concat(F.coalesce("constraint", F.lit("")), F.lit("x"))).otherwise(F.col("constraint"))),
        property_tags=e.select("export_key", F.lit("field").alias("name"), F.when(F.col("size") % 2 == 0, "string").otherwise("number").alias("type"), F.lit("{number} text").alias("tag_text")),
    )
    return api.scan(s, pages=_rows(spark, "page string, status string", ("a.md", "pass"), ("b.md", "fail")))


@query("tool_call", "SELECT 'coverage' AS command, (SELECT count(DISTINCT spec_id) FROM exports WHERE NOT (source_package IS NOT NULL AND source_file IS NULL)) AS rows, true AS ok UNION ALL SELECT 'nothing', NULL, false", "exports")
def _(spark, sf):
    """A command called by name, and one that there isn't."""
    s = api.Surface(derive(spark, sf, "exports"))
    line = api.call_tool("coverage", s).select(F.from_json("value", "ok boolean, data array<struct<spec_id:string>>, meta struct<command:string>").alias("v")).select("v.meta.command", F.size("v.data").cast("bigint").alias("rows"), "v.ok")
    bad = api.call_tool("nothing", s).select(F.from_json("value", "ok boolean, command string").alias("v")).select("v.command", F.lit(None).cast("bigint").alias("rows"), "v.ok")
    return line.unionByName(bad)


# -- prose


@query("prose_members", """SELECT concat('p', p_partkey) AS path, 2 AS block, CASE p_size % 7 WHEN 0 THEN 'x.gone' WHEN 5 THEN 'u.gone' ELSE 'x.deep' END AS target FROM part WHERE p_size % 7 IN (0, 5, 6)""")
def _(spark, sf):
    """Receivers made by the package, of other packages, parameters, locals with built-in methods, undeclared ones."""
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 7).alias("k"))
    fact = lambda block, pos, fact, name, obj=None, module=None, kind=None: F.struct(F.lit(block).alias("block"), F.lit(pos).alias("pos"), F.lit(fact).alias("fact"), F.lit(name).alias("name"), F.lit(obj).cast("string").alias("object"), F.lit(module).cast("string").alias("module"), F.lit(kind).cast("string").alias("kind"), F.lit(block * 10 + pos).alias("line"))
    own = [fact(1, 0, "import", "make", "make", "pkg", "named"), fact(1, 1, "import", "other", "other", "else", "named"), fact(1, 2, "derived", "x", "make"), fact(1, 3, "derived", "y", "other"), fact(1, 4, "param", "p"), fact(1, 5, "local", "arr", kind="const")]
    calls = [("gone", "x"), ("run", "x"), ("gone", "other"), ("gone", "y"), ("gone", "p"), ("gone", "u"), ("deep", "x")]
    call = None
    for k, (name, obj) in enumerate(calls):
        both = F.array(fact(2, 0, "method", name, obj), fact(2, 1, "method", name, obj), fact(2, 2, "method", "map", "arr"))
        call = F.when(F.col("k") == k, both) if call is None else call.when(F.col("k") == k, both)
    facts = p.select("path", F.inline(F.concat(F.array(*own), call)))
    out = prose.unresolved_members(facts, "pkg", _rows(spark, "name string", ("Thing",)), _rows(spark, "member string", ("run",)), _rows(spark, "name string, gives string", ("make", "Thing")), _rows(spark, "name string", ("map",)))
    return out.select("path", "block", "target")


@query("prose_deprecated", "SELECT concat('p', p_partkey) AS path, 1 AS block, CASE p_size % 5 WHEN 0 THEN 'old' WHEN 1 THEN 'drop' ELSE 'gone' END AS target, CASE p_size % 5 WHEN 0 THEN 'use new' ELSE '' END AS note FROM part WHERE p_size % 5 IN (0, 1, 4)")
def _(spark, sf):
    """Deprecated imports and calls, once a file; the receiver's type decides where it is known."""
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 5).alias("k"))
    fact = lambda block, pos, fact, name, obj=None, module=None: F.struct(F.lit(block).alias("block"), F.lit(pos).alias("pos"), F.lit(fact).alias("fact"), F.lit(name).alias("name"), F.lit(obj).cast("string").alias("object"), F.lit(module).cast("string").alias("module"), F.lit(block).alias("line"))
    cases = [
        [fact(1, 0, "import", "old", "old", "pkg"), fact(2, 0, "import", "old", "old", "pkg/sub")], [fact(1, 0, "derived", "x", "make"), fact(1, 1, "method", "drop", "x"), fact(2, 1, "method", "drop", "x")],
        [fact(1, 0, "derived", "x", "build"), fact(1, 1, "method", "drop", "x")], [fact(1, 0, "method", "drop", "u")], [fact(1, 0, "method", "gone", "u")],
    ]
    some = None
    for k, c in enumerate(cases):
        some = F.when(F.col("k") == k, F.array(*c)) if some is None else some.when(F.col("k") == k, F.array(*c))
    flags = _rows(spark, "class string, member string, deprecated boolean", ("Thing", "drop", True), ("Other", "drop", False), ("Thing", "gone", True))
    out = prose.deprecated_references(p.select("path", F.inline(some)), "pkg", _rows(spark, "name string, note string", ("old", "use new")), registry.member_owners(flags), _rows(spark, "name string, gives string", ("make", "Thing"), ("build", "Other")), flags)
    return out.select("path", "block", "target", "note")


@query("code_facts", """WITH f AS (SELECT concat('e', event_id) AS path, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos, unnest(['import', 'local', 'derived', 'identifier', 'call', 'identifier', 'identifier', 'method']) AS fact, unnest([event_type, 'made', 'made', 'made', 'use', 'use', 'made', 'run']) AS name,
unnest(['use', NULL, 'use', NULL, NULL, NULL, NULL, 'made']) AS object, unnest(['pkg', NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS module, unnest(['named', 'const', NULL, 'value', NULL, 'call', 'value', NULL]) AS kind, unnest([1, 2, 2, 2, 2, 2, 3, 3]) AS line FROM events) SELECT path, 1 AS block, pos, fact, name, object, module, kind, line FROM f""")
def _(spark, sf):
    e = spread(table(spark, sf, "events"))
    code = F.concat(F.lit("import { "), F.col("event_type"), F.lit(" as use } from 'pkg'\nconst made = await use("), F.col("value").cast("string"), F.lit(")\nmade.run("), F.col("user_id").cast("string"), F.lit(") // "), F.col("props"))
    return code_facts.facts(e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), F.lit(1).alias("block"), code.alias("code"), F.lit(1).alias("line_start")))


@query("impact_stats", f"WITH i AS ({_RAW['docs_impact'][0]}) SELECT count(DISTINCT path) AS files, count(DISTINCT concat(path, ':', block)) AS blocks, count(*) AS \"references\", count(*) > 0 AS touched FROM i")
def _(spark, sf):
    out = versions.impact_stats(queries()["docs_impact"](spark, sf))
    return out.withColumn("touched", F.col("references") > 0)


# -- examples


@query("example_counts", "WITH x AS (SELECT p_size % 3 = 0 AS bad FROM part WHERE p_size % 4 <> 0) SELECT count(*) AS total, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed FROM x")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("export_key"), F.lit(0).alias("ex_pos"), F.when(F.col("p_size") % 4 == 0, "  ").otherwise("f()").alias("code"), "p_size")
    bad = p.where("p_size % 3 = 0")
    return scoring.example_counts(bad.unionByName(bad), p)


@query("example_identifiers", f"""WITH src AS (SELECT DISTINCT concat(name, 'Big') AS source FROM exports), cand AS (SELECT concat(name, CASE WHEN min(size) % 2 = 0 THEN 'Big' ELSE 'Bag' END, 's') AS candidate, min(export_pos) AS pos FROM exports GROUP BY name), {_CLOSE}
SELECT e.export_key, concat(e.name, 'Big') AS target, b.candidate AS suggestion FROM (SELECT DISTINCT export_key, name FROM exports WHERE size % 2 = 0) e JOIN best b ON b.source = concat(e.name, 'Big') AND b.n = 1 WHERE CAST(floor(10 * (1 - b.total) + 0.5) AS INT) <= 5""", "exports")
def _(spark, sf):
    """Identifiers of examples that nothing declares, with the nearest known name."""
    e = derive(spark, sf, "exports")
    facts = e.select("export_key", F.concat("name", F.lit("Big")).alias("name"), (F.col("size") % 2 == 1).alias("is_local")).unionByName(e.select("export_key", F.lit("Promise").alias("name"), F.lit(False).alias("is_local"))).unionByName(e.select("export_key", F.lit("i").alias("name"), F.lit(False).alias("is_local")))
    names = e.groupBy("name").agg(F.min("size").alias("s"), F.min("export_pos").alias("pos")).select(F.concat("name", F.when(F.col("s") % 2 == 0, "Big").otherwise("Bag"), F.lit("s")).alias("name"), "pos")
    return findings.unknown_identifiers(facts, names, _rows(spark, "name string", ("Promise",))).select("export_key", "target", "suggestion")


# -- lists and lookups


@query("list_kinds", f"SELECT export_key, name FROM exports WHERE kind IN ('function', 'class') AND NOT {_DOC}", "exports")
def _(spark, sf):
    return api.listing(api.Surface(derive(spark, sf, "exports")), kinds=["Function", "CLASS"], undocumented=True).select("export_key", "name")


@query("list_search", """SELECT export_key, CAST(CASE WHEN lower(name) = 'smallring' THEN 100 WHEN starts_with(lower(name), 'smallring') THEN 90 WHEN contains(lower(name), 'smallring') THEN 70 ELSE 50 - 10 * levenshtein('smallring', lower(name)) END AS INT) AS score FROM exports
WHERE contains(lower(name), 'smallring') OR (abs(length(name) - 9) <= 3 AND levenshtein('smallring', lower(name)) <= 2)""", "exports")
def _(spark, sf):
    return api.listing(api.Surface(derive(spark, sf, "exports")), search="smallRing").select("export_key", "score")


@query("name_suggestions", """WITH s AS (SELECT export_key, export_pos, CASE WHEN starts_with(lower(name), 'bolt') THEN 90 ELSE 70 END AS score FROM exports WHERE contains(lower(name), 'bolt')) SELECT export_key FROM s ORDER BY score DESC, export_pos LIMIT 3""", "exports")
def _(spark, sf):
    return api.suggestions(api.Surface(derive(spark, sf, "exports")), "bolt").select("export_key")


@query("spec_filter", "SELECT (SELECT count(*) FROM exports WHERE kind = 'class' AND contains(lower(name), 'ring') AND NOT deprecated AND size % 3 = 0) AS matched, count(*) AS total, (SELECT count(*) FROM exports WHERE kind = 'class' AND contains(lower(name), 'ring') AND NOT deprecated AND size % 3 = 0) AS rows FROM exports", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports").withColumn("tag_names", F.when(F.col("size") % 3 == 0, F.array(F.lit("beta"))).otherwise(F.array().cast("array<string>")))
    rows, counts = api.filtered(api.Surface(e), kind="class", search="Ring", deprecated=False, tag="beta")
    return counts.withColumn("rows", F.lit(rows.count()).cast("bigint"))


@query("filter_merge", """SELECT export_key, CASE size % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'b,c' WHEN 2 THEN 'a,b' ELSE '' END AS include, CASE WHEN size % 2 = 0 THEN 'x,y' ELSE 'x,z' END AS exclude FROM exports""", "exports")
def _(spark, sf):
    text = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    k = F.col("size") % 4
    e = derive(spark, sf, "exports").select("export_key", F.when(k.isin(0, 2), text("a", "b")).when(k == 1, text()).otherwise(text("q")).alias("include_a"), F.when(k.isin(0, 1), text("b", "c")).when(k == 2, text()).otherwise(text("r")).alias("include_b"), text("x").alias("exclude_a"), F.when(F.col("size") % 2 == 0, text("x", "y")).otherwise(text("z")).alias("exclude_b"))
    out = predicates.merge_filters(e)
    return out.select("export_key", F.array_join("include", ",").alias("include"), F.array_join("exclude", ",").alias("exclude"))


@query("filter_missing", "SELECT concat(p_name, '!') AS name FROM part GROUP BY 1", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    wanted = table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name", F.lit("! ")).alias("name")).unionByName(e.select(F.upper("name").alias("name"))).unionByName(e.select("export_key").toDF("name"))
    return predicates.missing_names(wanted, e)


@query("page_of_exports", "SELECT export_key, name FROM exports ORDER BY name, export_key LIMIT 25 OFFSET 50", "exports")
def _(spark, sf):
    return predicates.page(derive(spark, sf, "exports").select("export_key", "name"), 3, 25, "name", "export_key")


@query("page_clamped", "SELECT export_key FROM (SELECT export_key, row_number() OVER (ORDER BY name, export_key) AS n, count(*) OVER () AS c FROM exports) t WHERE n > ((c - 1) // 300) * 300", "exports")
def _(spark, sf):
    return predicates.page(derive(spark, sf, "exports").select("export_key", "name"), 10**6, 300, "name", "export_key").select("export_key")


@query("symbol_modules", "SELECT DISTINCT n.name, coalesce((SELECT arg_min(spec_id, CAST(substr(spec_id, 7) AS INT)) FROM exports e WHERE e.name = n.name AND size > 25), (SELECT arg_min(class, CAST(substr(class, 7) AS INT)) FROM members m WHERE m.member = n.name)) AS module FROM (SELECT name FROM exports UNION SELECT member FROM members UNION SELECT 'nowhere') n", "exports", "members")
def _(spark, sf):
    e, m = derive(spark, sf, "exports"), derive(spark, sf, "members")
    pos = lambda c: F.expr(f"cast(substr({c}, 7) as int)")
    types = m.select(F.col("member").alias("name"), F.col("class").alias("spec_id"), pos("class").alias("module_pos"))
    wanted = e.select("name").unionByName(m.select(F.col("member").alias("name"))).unionByName(_rows(spark, "name string", ("nowhere",)))
    return registry.find_module(wanted, e.where("size > 25").withColumn("module_pos", pos("spec_id")), types)


@query("names_last_wins", "SELECT spec_id, name, arg_max(export_key, export_pos) AS last, arg_min(export_key, export_pos) AS first FROM exports GROUP BY spec_id, name", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    last = predicates.last_wins(e, ["spec_id", "name"], "export_pos").select("spec_id", "name", F.col("export_key").alias("last"))
    return last.join(predicates.first_wins(e, ["spec_id", "name"], "export_pos").select("spec_id", "name", F.col("export_key").alias("first")), ["spec_id", "name"])


@query("analysis_lookup", "SELECT export_key, CASE WHEN size % 3 = 0 THEN size ELSE 100 END AS score, CASE WHEN size % 3 = 0 AND size % 2 = 0 THEN 'params' ELSE '' END AS missing, NOT (size % 3 = 0 AND size % 2 = 0) AS complete FROM exports", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    a = e.where("size % 3 = 0").select("export_key", F.col("size").alias("score"), F.when(F.col("size") % 2 == 0, F.array(F.lit("params"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    out = scoring.analysis_of(e, a)
    return out.select("export_key", "score", F.array_join("missing", ",").alias("missing"), "complete")


# -- keys


@query("type_keys", "SELECT p_brand AS type, concat('k', p_size) AS key, min(p_partkey) AS pos, arg_max(p_partkey % 2 = 0, p_partkey) FILTER (p_partkey % 3 = 0) AS deprecated, arg_max(p_name, p_partkey) FILTER (p_partkey % 5 = 0) AS reason, arg_max(p_partkey % 7 = 0, p_partkey) AS internal FROM part GROUP BY 1, 2")
def _(spark, sf):
    p = table(spark, sf, "part")
    k = lambda n: F.col("p_partkey") % n == 0
    return keys.type_keys(p.select(F.col("p_brand").alias("type"), F.concat(F.lit("k"), F.col("p_size").cast("string")).alias("key"), F.col("p_partkey").alias("pos"), F.when(k(3), k(2)).alias("deprecated"), F.when(k(5), F.col("p_name")).alias("reason"), k(7).alias("internal")))


@query("candidate_types", "SELECT p_brand AS type FROM part GROUP BY 1 HAVING count(DISTINCT CASE WHEN right(p_brand, 1) IN ('1', '3', '5') THEN p_size % 3 ELSE p_size END) >= 6")
def _(spark, sf):
    key = F.when(F.substring("p_brand", -1, 1).isin("1", "3", "5"), F.col("p_size") % 3).otherwise(F.col("p_size"))
    return keys.candidate_types(table(spark, sf, "part").select(F.col("p_brand").alias("type"), F.concat(F.lit("k"), key.cast("string")).alias("key")), 6)


@query("key_order", "SELECT p_brand AS page, p_name AS key, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS INT) AS by_code, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_name) AS INT) AS by_name FROM (SELECT DISTINCT p_brand, CASE WHEN p_size % 2 = 0 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2, 2), 'X') ELSE concat(substr(p_name, 1, 3), 'a') END AS p_name FROM part)")
def _(spark, sf):
    """Keys by code unit and as people sort them."""
    p = table(spark, sf, "part")
    key = F.when(F.col("p_size") % 2 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 2), F.lit("X"))).otherwise(F.concat(F.substring("p_name", 1, 3), F.lit("a")))
    return keys.ordered_keys(p.select(F.col("p_brand").alias("page"), key.alias("key")))


# -- versions and packages


@query("issue_delta", "WITH x AS (SELECT (SELECT count(*) FROM exports WHERE size % 3 = 0) AS old_issues, (SELECT count(*) FROM exports WHERE size % 4 = 0) AS new_issues) SELECT *, greatest(0, new_issues - old_issues) AS introduced, greatest(0, old_issues - new_issues) AS resolved FROM x", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    return versions.issue_delta(e.where("size % 3 = 0"), e.where("size % 4 = 0"))


@query("diff_with_docs", _DIFF + f""", c AS (SELECT count(*) FILTER (change = 'breaking') AS breaking, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'docs-only') AS docs_only FROM diff),
o2 AS (SELECT export_key AS id, size AS a FROM exports WHERE export_pos % 10 <> 1), n2 AS (SELECT export_key AS id, 100 - size AS b FROM exports WHERE export_pos % 10 <> 0)
SELECT c.*, 'major' AS bump, (SELECT CAST(floor(avg(a) + 0.5) AS INT) FROM o2) AS old_coverage, (SELECT CAST(floor(avg(b) + 0.5) AS INT) FROM n2) AS new_coverage, (SELECT CAST(floor(avg(b) + 0.5) AS INT) FROM n2) - (SELECT CAST(floor(avg(a) + 0.5) AS INT) FROM o2) AS delta,
(SELECT count(*) FROM o2 JOIN n2 USING (id) WHERE b > a) AS improved, (SELECT count(*) FROM o2 JOIN n2 USING (id) WHERE b < a) AS regressed, (SELECT count(*) FROM exports WHERE size % 3 = 0) AS old_issues, (SELECT count(*) FROM exports WHERE size % 2 = 0) AS new_issues,
greatest(0, (SELECT count(*) FROM exports WHERE size % 2 = 0) - (SELECT count(*) FROM exports WHERE size % 3 = 0)) AS introduced, greatest(0, (SELECT count(*) FROM exports WHERE size % 3 = 0) - (SELECT count(*) FROM exports WHERE size % 2 = 0)) AS resolved,
(SELECT count(*) FROM exports WHERE export_pos % 10 = 1 AND NOT {_DOC}) AS new_undocumented FROM c""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    more = e.select(F.col("export_key").alias("id"), "description", "size")
    old, new = _versions(spark, sf)
    old = old.join(more, "id").withColumn("score", F.col("size"))
    new = new.join(more, "id").withColumn("score", 100 - F.col("size"))
    return versions.diff_with_docs(old, new, e.where("size % 3 = 0"), e.where("size % 2 = 0"))


@query("next_versions", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_size + 1, '.0.0') WHEN 1 THEN concat(p_size, '.3.0') WHEN 2 THEN concat(p_size, '.2.10') ELSE concat(p_size, '.2.9') END AS version FROM part")
def _(spark, sf):
    bump = F.element_at(F.array(*[F.lit(b) for b in ("major", "minor", "patch", "none")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", versions.next_version(F.concat(F.col("p_size").cast("string"), F.lit(".2.9-beta+1")), bump).alias("version"))


@query("member_renames", """WITH g AS (SELECT DISTINCT spec_id AS class, concat(name, 'Old') AS source FROM exports WHERE size % 2 = 0), f AS (SELECT DISTINCT spec_id AS class, concat(name, 'New') AS candidate FROM exports WHERE size % 2 = 0),
w AS (SELECT class, source, candidate, string_split(lower(regexp_replace(source, '([a-z])([A-Z])', '\\1 \\2', 'g')), ' ') AS a, string_split(lower(regexp_replace(candidate, '([a-z])([A-Z])', '\\1 \\2', 'g')), ' ') AS b FROM g JOIN f USING (class)),
s AS (SELECT *, a[len(a)] = b[len(b)] AS suf FROM w), m AS (SELECT *, CASE WHEN suf THEN 2.0::DOUBLE ELSE 0::DOUBLE END + len(list_filter(a, lambda q: list_contains(b, q))) AS n FROM s),
t AS (SELECT class, source, candidate, CASE WHEN suf THEN 1.5::DOUBLE * n / greatest(len(a), len(b)) + sp ELSE n / greatest(len(a), len(b)) + 0.5::DOUBLE * sp END AS score FROM (SELECT *, 1 - levenshtein(lower(source), lower(candidate))::DOUBLE / greatest(length(source), length(candidate)) AS sp FROM m))
SELECT class, source AS member, 'removed' AS change, candidate AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY class, source ORDER BY score DESC, candidate DESC) AS n FROM t WHERE score >= 0.5) WHERE n = 1""", "exports")
def _(spark, sf):
    """Removed members with the likest added one of their class."""
    e = derive(spark, sf, "exports").where("size % 2 = 0")
    side = lambda end: e.select(F.col("spec_id").alias("class"), F.concat("name", F.lit(end)).alias("member"), F.col("export_pos").alias("pos"), F.lit("method").alias("kind"), F.lit("()").alias("signature"))
    return versions.member_diff(side("Old"), side("New")).where("change = 'removed'").select("class", "member", "change", "suggestion")


@query("member_change_filters", "SELECT class, count(*) FILTER (change = 'removed') > 0 AS any_removed, count(*) FILTER (change = 'added') > 0 AS any_added, count(*) AS changes FROM (" + _RAW["member_diff"][0] + ") t GROUP BY class", "members")
def _(spark, sf):
    d = queries()["member_diff"](spark, sf)
    return d.groupBy("class").agg(F.bool_or(F.col("change") == "removed").alias("any_removed"), F.bool_or(F.col("change") == "added").alias("any_added"), F.count("*").alias("changes"))


@query("ci_packages", f"""WITH p AS (SELECT DISTINCT p_brand AS spec_id FROM part UNION SELECT 'Empty'), c AS (SELECT spec_id, count(*) AS exports, count(*) FILTER ({_DOC}) AS documented FROM exports GROUP BY 1), i AS (SELECT spec_id, count(*) AS issues FROM exports WHERE deprecated <> tag_deprecated GROUP BY 1)
SELECT p.spec_id, coalesce(exports, 0) AS exports, coalesce(documented, 0) AS documented, coalesce(CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT), 0) AS score, coalesce(issues, 0) AS issues, coalesce(CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT), 0) >= 70 AS passes FROM p LEFT JOIN c USING (spec_id) LEFT JOIN i USING (spec_id) WHERE p.spec_id LIKE '%1%' OR p.spec_id = 'Empty'""", "exports")
def _(spark, sf):
    packages = table(spark, sf, "part").select("p_brand").distinct().unionByName(_rows(spark, "p_brand string", ("Empty",))).select(F.col("p_brand").alias("spec_id"), F.concat(F.lit("packages/"), "p_brand").alias("dir"))
    changed = packages.where("spec_id LIKE '%1%' OR spec_id = 'Empty'").select(F.concat("dir", F.lit("/src/a.ts")).alias("path"))
    return api.ci(api.Surface(derive(spark, sf, "exports")), packages, changed, 70).select("spec_id", "exports", "documented", "score", "issues", "passes")


@query("batch_diff", _DIFF + "SELECT spec_id, count(*) FILTER (change = 'breaking') AS breaking, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'docs-only') AS docs_only FROM diff GROUP BY ROLLUP (spec_id)", "exports")
def _(spark, sf):
    old, new = _versions(spark, sf)
    where = old.select("id", "spec_id").unionByName(new.select("id", "spec_id")).distinct()
    d = versions.spec_diff(old, new).join(where, "id")
    return d.rollup("spec_id").agg(*[F.count_if(F.col("change") == k).alias(n) for k, n in (("breaking", "breaking"), ("added", "added"), ("docs-only", "docs_only"))])


@query("package_probe", f"SELECT count(*) AS exports, count(*) FILTER ({_DOC}) AS documented, {_PCT.format(p=f'count(*) FILTER ({_DOC})', w='count(*)')} AS coverage, CAST(floor(0.5::DOUBLE * {_PCT.format(p=f'count(*) FILTER ({_DOC})', w='count(*)')} + 50 + 0.5) AS INT) AS health FROM exports WHERE NOT (source_package IS NOT NULL AND source_file IS NULL)", "exports")
def _(spark, sf):
    return scoring.probe(derive(spark, sf, "exports"))


@query("package_context", "SELECT e.spec_id, name, coalesce(CASE WHEN size % 3 = 0 THEN 'own.ts' END, source_file) AS file, source_line AS line FROM exports e WHERE deprecated <> tag_deprecated", "exports")
def _(spark, sf):
    """Issues of a package with their place: the finding's, else the export's."""
    e = derive(spark, sf, "exports")
    f = findings.deprecation(e).join(e.select("export_key", F.when(F.col("size") % 3 == 0, "own.ts").alias("file")), "export_key")
    return api.package_context(e, f).select("spec_id", "name", "file", "line")


@query("window_delta", """WITH d AS (SELECT date, CAST(floor(avg(coverage) + 0.5) AS INT) AS average FROM history GROUP BY date), r AS (SELECT * FROM d WHERE date BETWEEN DATE '2024-01-20' - 7 AND DATE '2024-01-20') SELECT arg_min(average, date) AS "from", arg_max(average, date) AS "to", arg_max(average, date) - arg_min(average, date) AS delta FROM r""", "history")
def _(spark, sf):
    return history.window_delta(derive(spark, sf, "history"), "2024-01-20", 7)


# -- checks


@query("invalid_findings", "SELECT export_key, array_to_string(list_filter([CASE WHEN size % 2 = 0 THEN 'type is unknown' END, CASE WHEN size % 3 = 0 THEN 'target is missing' END], lambda x: x IS NOT NULL), ';') AS errors FROM exports WHERE size % 2 = 0 OR size % 3 = 0", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports").select("export_key", F.when(F.col("size") % 4 == 0, "odd").when(F.col("size") % 2 == 1, "broken-link").alias("type"), F.when(F.col("size") % 3 != 0, F.col("name")).alias("target"))
    return validation.check_findings(e).select("export_key", F.array_join("errors", ";").alias("errors"))


@query("invalid_analyses", "SELECT name, array_to_string(list_filter([CASE WHEN size % 2 = 0 THEN 'score is out of range' END, CASE WHEN size % 3 = 0 THEN 'unknown rule' END, CASE WHEN size % 5 = 0 THEN 'issues are negative' END], lambda x: x IS NOT NULL), ';') AS errors FROM exports WHERE size % 2 = 0 OR size % 3 = 0 OR size % 5 = 0", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports").select("name", F.when(F.col("size") % 4 == 0, 101).when(F.col("size") % 2 == 1, 50).alias("score"), F.array(F.lit("params"), F.when(F.col("size") % 3 == 0, "odd").otherwise("returns")).alias("missing"), F.when(F.col("size") % 5 == 0, -1).otherwise(0).alias("issues"))
    return validation.check_analysis(e).select("name", F.array_join("errors", ";").alias("errors"))


@query("invalid_totals", "SELECT spec_id, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'complete exceeds total' END, CASE WHEN k % 3 = 0 THEN 'score is out of range' END], lambda x: x IS NOT NULL), ';') AS errors FROM (SELECT spec_id, count(*) AS k FROM exports GROUP BY 1) WHERE k % 2 = 0 OR k % 3 = 0", "exports")
def _(spark, sf):
    t = derive(spark, sf, "exports").groupBy("spec_id").agg(F.count("*").alias("k")).select("spec_id", F.lit(5).alias("total"), F.when(F.col("k") % 2 == 0, 6).otherwise(5).alias("complete"), F.when(F.col("k") % 3 == 0, -1).otherwise(100).alias("score"))
    return validation.check_totals(t).select("spec_id", F.array_join("errors", ";").alias("errors"))


@query("invalid_exports", "SELECT export_pos, array_to_string(list_filter([CASE WHEN size % 3 = 0 THEN 'name is missing' END, CASE WHEN size % 4 = 0 THEN 'unknown kind' END, CASE WHEN size % 5 = 0 THEN 'no id and no name' END], lambda x: x IS NOT NULL), ';') AS errors FROM exports WHERE size % 3 = 0 OR size % 4 = 0 OR size % 5 = 0", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports").select("export_pos", F.when(F.col("size") % 3 != 0, F.col("name")).alias("name"), F.when(F.col("size") % 8 == 0, "odd").when(F.col("size") % 4 != 0, F.col("kind")).alias("kind"), F.when(F.col("size") % 5 != 0, F.col("export_key")).alias("export_key"))
    return api.validate(e).select("export_pos", F.array_join("errors", ";").alias("errors"))


# -- pages


@query("envelope", "SELECT true AS ok, 'coverage' AS command, 12 AS duration, (SELECT count(DISTINCT spec_id) FROM exports) AS rows, 'lint' AS next, (SELECT count(*) FROM exports) AS exports", "exports")
def _(spark, sf):
    """The envelope of a result, read back."""
    c = derive(spark, sf, "exports").groupBy("spec_id").agg(F.count("*").alias("exports"))
    v = render.envelope(c, "coverage", "1.0", 12, ["lint"]).select(F.from_json("value", "ok boolean, data array<struct<spec_id:string,exports:bigint>>, meta struct<command:string,duration:int,version:string>, next array<string>").alias("v"))
    return v.select("v.ok", "v.meta.command", "v.meta.duration", F.size("v.data").cast("bigint").alias("rows"), F.element_at("v.next", 1).alias("next"), F.aggregate("v.data", F.lit(0).cast("bigint"), lambda a, r: a + r["exports"]).alias("exports"))


@query("error_envelope", "SELECT '{\"ok\":false,\"error\":{\"message\":\"no such export\",\"code\":1},\"command\":\"get\"}' AS value UNION ALL SELECT '{\"ok\":false,\"error\":{\"message\":\"bad option\",\"code\":2},\"command\":\"scan\"}'")
def _(spark, sf):
    return render.error_envelope(spark, "get", "no such export", not_found=True).unionByName(render.error_envelope(spark, "scan", "bad option"))


_LISTED = "string_agg({text}, chr(10) ORDER BY {order})"


@query("changelog_page", _DIFF + f"""SELECT concat_ws(concat(chr(10), chr(10)), '## 2.0.0', concat('### Breaking', chr(10), chr(10), {_LISTED.format(text="concat('- ', id)", order="id")} FILTER (change = 'breaking')), concat('### Added', chr(10), chr(10), {_LISTED.format(text="concat('- ', id)", order="id")} FILTER (change = 'added')), concat('### Documentation', chr(10), chr(10), {_LISTED.format(text="concat('- ', id)", order="id")} FILTER (change = 'docs-only'))) AS value FROM diff""", "exports")
def _(spark, sf):
    return api.changelog(*_versions(spark, sf), "1.4.2", "major")


@query("context_page", _PACKAGES + f""", c AS (SELECT spec_id, CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT) AS score, issues FROM cov), top AS (SELECT * FROM c ORDER BY issues DESC, spec_id LIMIT 3), u AS (SELECT name, export_key FROM exports WHERE NOT {_DOC} ORDER BY name, export_key LIMIT 10)
SELECT concat('# Documentation state', chr(10), chr(10), '| Package | Coverage | Issues |', chr(10), '|---|---|---|', chr(10), (SELECT {_LISTED.format(text="concat('| ', spec_id, ' | ', score, '% | ', issues, ' |')", order="spec_id")} FROM c), chr(10), chr(10), '## Attention', chr(10), chr(10), (SELECT {_LISTED.format(text="concat('- ', spec_id, ': ', issues, ' issues')", order="issues DESC, spec_id")} FROM top), chr(10), chr(10), '## Undocumented', chr(10), chr(10), (SELECT {_LISTED.format(text="concat('- ', name)", order="name, export_key")} FROM u)) AS value""", "exports")
def _(spark, sf):
    p = _packages(spark, sf).withColumn("score", S.percent("documented", "exports"))
    return render.context_markdown(p, derive(spark, sf, "exports").where(~predicates.documented()))


@query("review_comment", _DIFF + f""", c AS (SELECT spec_id, count(*) AS n FROM exports GROUP BY 1), b AS (SELECT id, CASE WHEN kind IN ('function', 'class') THEN 'high' WHEN kind IN ('interface', 'type', 'enum') THEN 'medium' ELSE 'low' END AS severity FROM diff WHERE change = 'breaking')
SELECT concat('<!-- documentation report -->', chr(10), '| Package | Coverage | Issues | State |', chr(10), '|---|---|---|---|', chr(10), (SELECT {_LISTED.format(text="concat('| ', spec_id, ' | ', n, '% | ', n % 3, ' | ', CASE WHEN n % 2 = 0 THEN 'ok' ELSE 'below minimum' END, ' |')", order="spec_id")} FROM c), chr(10), chr(10), '### Breaking', chr(10), chr(10), (SELECT {_LISTED.format(text="concat('- ', id, ' (', severity, ')')", order="CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, id")} FROM b)) AS value""", "exports")
def _(spark, sf):
    c = derive(spark, sf, "exports").groupBy("spec_id").agg(F.count("*").alias("n")).select("spec_id", F.col("n").alias("score"), (F.col("n") % 3).alias("issues"), (F.col("n") % 2 == 0).alias("passes"))
    return render.pull_request_comment(c, versions.breaking_severity(versions.spec_diff(*_versions(spark, sf))))


@query("package_list", "WITH p AS (SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey % 4 <> 0), f AS (SELECT name FROM p ORDER BY lower(name) LIMIT 10) SELECT concat((SELECT string_agg(concat('- ', name), chr(10) ORDER BY name) FROM f), chr(10), '… and ', (SELECT count(*) - 10 FROM p), ' more') AS value")
def _(spark, sf):
    return render.package_list(table(spark, sf, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 == 0).alias("private")))


@query("declarations", """WITH s AS (SELECT export_key, sig_pos, concat('(', string_agg(concat(name, CASE WHEN NOT required THEN '?' ELSE '' END, ': ', type), ', ' ORDER BY param_pos), '): ') AS text FROM params GROUP BY 1, 2), f AS (SELECT export_key, arg_min(text, sig_pos) AS text FROM s GROUP BY 1)
SELECT e.export_key, CASE kind WHEN 'class' THEN concat('class ', name, CASE WHEN size % 2 = 0 THEN ' extends Base' ELSE '' END) WHEN 'interface' THEN concat('type ', name, ' = ', CASE WHEN size % 3 = 0 THEN 'string' ELSE '{ ... }' END) WHEN 'type' THEN concat('type ', name, ' = ', CASE WHEN size % 3 = 0 THEN 'string' ELSE '{ ... }' END)
WHEN 'variable' THEN concat('const ', name, ': ', CASE WHEN size % 3 = 0 THEN 'string' ELSE 'unknown' END) WHEN 'enum' THEN concat('enum ', name, ' { ... }') ELSE concat('function ', name, coalesce(concat(f.text, coalesce(r.actual_type, 'void')), '(): unknown')) END AS declaration FROM exports e LEFT JOIN f USING (export_key) LEFT JOIN returns r USING (export_key)""", "exports", "params", "returns")
def _(spark, sf):
    """One line for each export, functions with their first signature."""
    sig = render.signatures(derive(spark, sf, "params"), derive(spark, sf, "returns")).groupBy("export_key").agg(F.min_by("signature", "sig_pos").alias("signature"))
    e = derive(spark, sf, "exports").join(sig, "export_key", "left")
    kind = F.when(F.col("kind") == "function", F.col("signature")).when(F.col("size") % 3 == 0, "string")
    return e.select("export_key", render.declaration("kind", "name", kind, F.when(F.col("size") % 2 == 0, "Base")).alias("declaration"))


@query("displayed_params", "WITH f AS (SELECT export_key, min(sig_pos) AS sig_pos FROM params GROUP BY 1) SELECT export_key, param_pos, name, type, NOT required AS optional FROM params JOIN f USING (export_key, sig_pos)", "params")
def _(spark, sf):
    return render.display_params(derive(spark, sf, "params")).select("export_key", F.col("param_pos").cast("bigint").alias("param_pos"), "name", "type", "optional")


@query("example_strings", "SELECT export_key, unnest(CASE WHEN size % 2 = 0 THEN ['f()', 'g()'] ELSE ['f()'] END) AS code FROM exports", "exports")
def _(spark, sf):
    """Examples that are text, or objects with code; others don't count."""
    x = F.array(F.lit('"f()"'), F.when(F.col("size") % 2 == 0, F.lit('{"code":"g()"}')).otherwise(F.lit("12")), F.lit('{"title":"no code"}'))
    return findings.string_examples(derive(spark, sf, "exports").select("export_key", x.alias("examples"))).select("export_key", "code")


@query("custom_assertions", "SELECT export_key, 'example-assertion' AS type, 'line 1' AS target, CAST(size AS VARCHAR) AS expected, CAST(size + 1 AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM exports WHERE size % 2 = 0", "exports")
def _(spark, sf):
    """Assertions read by a parser of the caller's own, where an example has comments but none of the usual form."""
    e = derive(spark, sf, "exports")
    examples = e.select("export_key", F.lit(0).alias("ex_pos"), F.concat(F.lit("f() // gives "), F.col("size").cast("string")).alias("code"))
    results = e.select("export_key", F.lit(0).alias("ex_pos"), F.lit(True).alias("success"), F.when(F.col("size") % 2 == 0, F.col("size") + 1).otherwise(F.col("size")).cast("string").alias("stdout"))
    gives = lambda code: F.array(F.struct(F.lit(1).alias("line"), F.regexp_extract(code, "// gives (.+)$", 1).alias("expected")))
    return findings.failed_assertions(examples, results, parser=gives)


@query("custom_languages", "SELECT export_key FROM exports WHERE size % 3 <> 2", "exports")
def _(spark, sf):
    lang = F.when(F.col("size") % 3 == 0, "PY").when(F.col("size") % 3 == 1, "sh").otherwise("ts")
    return derive(spark, sf, "exports").where(predicates.executable_language(lang, ("py", "sh"))).select("export_key")
