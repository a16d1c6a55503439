"""Queries of the catalogue over texts: names, types, examples, comments, renderings, row predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _DOC, query, spread, table
from .functions import scalars as S
from .operators import predicates
from .plans.surface import derive
from .sources import doc_comments


def _pick(key: str, *values: str | None):
    """One of the values, by a number."""
    out = F.when(F.col(key) % len(values) == 0, F.lit(values[0]))
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.col(key) % len(values) == k, F.lit(v))
    return out


def _case(key: str, *values: str | None) -> str:
    """The same in SQL."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {text(v)}" for k, v in enumerate(values)) + " END"


_SPLIT = "array_to_string(list_filter(string_split_regex(lower({x}), '{by}'), lambda w: w <> ''), ',')"


@query("name_words", f"""SELECT export_key, {_SPLIT.format(x="regexp_replace(concat(name, 'XMLFile'), '([a-z])([A-Z])', '\\1 \\2', 'g')", by=" ")} AS simple,
{_SPLIT.format(x="concat(name, '-a.b/', spec_id)", by="[\\s_./:-]+")} AS compound,
{_SPLIT.format(x="regexp_replace(regexp_replace(concat(name, 'XMLFile_x'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')", by="[\\s_-]+")} AS camel FROM exports""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    words = lambda c: F.array_join(c, ",")
    return e.select("export_key", words(S.camel_words_simple(F.concat("name", F.lit("XMLFile")))).alias("simple"), words(S.compound_words(F.concat("name", F.lit("-a.b/"), "spec_id"))).alias("compound"), words(S.camel_words(F.concat("name", F.lit("XMLFile_x")))).alias("camel"))


_PROMISES = ["Promise<string>", "promise<Map<a, b>>", "string", "Promise", None]
_SCHEMAS = ['"string"', '{"type":"number"}', '{"$ref":"#/types/Foo"}', "boolean", '{"x":1}', None]
_TEMPLATES = ["{Base} T", "T extends Base - text", "T - text", " T", "T extends Map<a, b>", "{ a.B } Key more"]


@query("type_texts", f"""SELECT export_key, {_case("size", "string", "Map<a, b>", "string", "Promise", None)} AS unwrapped, {_case("size", "string", "number", "Foo", "boolean", None, None)} AS schema_type,
{_case("size", "T", "T", "T", "T", "T", "Key")} AS type_param, {_case("size", "Base", "Base", None, None, "Map<a, b>", "a.B")} AS type_constraint, {_case("size", None, "number", "string[]", None)} AS braces FROM exports""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports").withColumn("t", S.template_tag(_pick("size", *_TEMPLATES)))
    return e.select("export_key", S.unwrap_promise(_pick("size", *_PROMISES)).alias("unwrapped"), S.schema_type(_pick("size", *_SCHEMAS)).alias("schema_type"), F.col("t.name").alias("type_param"), F.col("t.constraint").alias("type_constraint"), S.braces_type(_pick("size", "text {a}", "{number} text", " { string[] } x", "{}")).alias("braces"))


_CODES = ["```ts\nconst a = 1\n```", "```\nx()\n```\n", "  plain() // note", "f() // => 3", "```js\ng() // => 1 // seen\n```"]


@query("example_texts", f"""SELECT export_key, {_case("size", "const a = 1", "x()", "plain() // note", "f() // => 3", "g() // => 1 // seen")} AS code, size % 5 IN (2, 4) AS commented,
CASE WHEN size % 3 = 0 THEN concat('before', chr(10), 'use ', name, chr(10), 'after') WHEN size % 3 = 1 THEN concat('use ', name, chr(10), 'after') ELSE substr(concat('nothing', repeat(' here', 30)), 1, 100) END AS snippet,
CASE WHEN size % 2 = 0 THEN concat(name, ' does', chr(10), 'this  * and that') ELSE name END AS comment,
CASE WHEN size % 2 = 0 THEN concat('see the ', name, ' and Other.thing') ELSE concat('see ', name) END AS rendered FROM exports""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    code = F.when(F.col("size") % 3 == 0, F.concat(F.lit("first\nbefore\nuse "), "name", F.lit("\nafter\nlast"))).when(F.col("size") % 3 == 1, F.concat(F.lit("use "), "name", F.lit("\nafter\nlast"))).otherwise(F.concat(F.lit("nothing"), F.repeat(F.lit(" here"), 30)))
    comment = F.when(F.col("size") % 2 == 0, F.concat(F.lit("/**\n * "), "name", F.lit(" does\n * this  * and that\n */"))).otherwise(F.concat(F.lit("/** "), "name", F.lit(" */")))
    links = F.when(F.col("size") % 2 == 0, F.concat(F.lit("see {@link x | the "), "name", F.lit("} and {@linkcode Other.thing}"))).otherwise(F.concat(F.lit("see {@link "), "name", F.lit("}")))
    return e.select("export_key", S.strip_fence(_pick("size", *_CODES)).alias("code"), S.has_plain_comment(_pick("size", *_CODES)).alias("commented"), S.context_snippet(code, "name").alias("snippet"), S.clean_comment(comment).alias("comment"), S.render_links(links).alias("rendered"))


_URLS = ["https://github.com/own/repo", "git@github.com:own/repo.git", "git+https://github.com/own/repo.git", "https://gitlab.example.org/own/repo/tree/v2/src", "ssh://git@github.com/own/repo.git/"]


@query("place_texts", f"""SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H-%M-%S'), '.json') AS snapshot, concat('a/', event_type, '~b') AS pointer, {_case("event_id", "own/repo@main", "own/repo@main", "own/repo@main", "own/repo@v2", "own/repo@main")} AS repo,
concat('reports/', event_type, '.md') AS report, concat('reports/diff-', substr(sha256(event_type), 1, 8), '-', substr(sha256(props), 1, 8), '.json') AS diff_report, event_id % 4 IN (0, 1, 2) AS is_path FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    repo = S.repository(_pick("event_id", *_URLS))
    return e.select("event_id", S.snapshot_name("ts").alias("snapshot"), S.unescape_pointer(F.concat(F.lit("a~1"), "event_type", F.lit("~0b"))).alias("pointer"), F.concat(repo["owner"], F.lit("/"), repo["repo"], F.lit("@"), repo["ref"]).alias("repo"),
        S.report_path("event_type", "markdown").alias("report"), S.report_path("event_type", "json", F.col("props")).alias("diff_report"), predicates.looks_like_path(_pick("event_id", "./x", "a/b", "file.ts", "word")).alias("is_path"))


@query("report_texts", """WITH d AS (SELECT event_id, CAST(event_id % 7 AS INT) - 3 AS d, CAST(event_id * 137 % 400000 AS BIGINT) AS ms, CAST(event_id % 3 AS INT) AS a, CAST(event_id % 2 AS INT) AS b FROM events)
SELECT event_id, CASE WHEN d > 0 THEN concat('↑', d) WHEN d < 0 THEN concat('↓', -d) ELSE '→' END AS glyph,
CASE WHEN ms < 1000 THEN concat(ms, 'ms') WHEN ms < 60000 THEN concat(printf('%.1f', ms / 1000.0::DOUBLE), 's') ELSE concat(ms // 60000, 'm ', CAST(floor((ms % 60000) / 1000.0::DOUBLE + 0.5) AS INT), 's') END AS duration,
CASE WHEN a = 0 AND b = 0 THEN 'no issues' ELSE array_to_string(list_filter([CASE WHEN a > 0 THEN concat(a, ' structural') END, CASE WHEN b > 0 THEN concat(b, ' prose') END], lambda x: x IS NOT NULL), ', ') END AS summary FROM d""")
def _(spark, sf):
    e = table(spark, sf, "events")
    n = lambda k: (F.col("event_id") % k).cast("int")
    return e.select("event_id", S.delta_glyph(n(7) - 3).alias("glyph"), S.duration_text(F.col("event_id") * 137 % 400000).alias("duration"), S.summary_line({"structural": n(3), "prose": n(2)}).alias("summary"))


@query("sparkline_rounded", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY date DESC, seq DESC) AS age FROM history), x AS (SELECT package, coverage, age, min(coverage) OVER w AS lo, max(coverage) OVER w AS hi FROM r WHERE age <= 10 WINDOW w AS (PARTITION BY package))
SELECT package, string_agg(substr('▁▂▃▄▅▆▇█', CAST(least(floor((coverage - lo)::DOUBLE / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 7 + 0.5), 7) AS INT) + 1, 1), '' ORDER BY age DESC) AS bars FROM x GROUP BY package""", "history")
def _(spark, sf):
    from .operators import history

    return history.trend(derive(spark, sf, "history")).select("package", S.sparkline_rounded("series").alias("bars"))


@query("row_predicates", f"""SELECT export_key, {_DOC} AS by_text, {_DOC} OR size % 3 = 0 AS by_text_or_tag, size % 3 <> 2 AS internal_tag, {_case("size", "a,b", "a", "", "x y,z")} AS parsed,
size % 5 IN (0, 1, 3) AS executable, size >= 20 AND (size % 2 = 0 OR size % 7 = 0) AS passes, {_case("size", "structural", "prose", "semantic", "example")} AS category,
size % 4 <> 0 OR size % 5 = 0 AS by_either FROM exports""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    tags = F.when(F.col("size") % 3 == 0, F.array(F.lit("see"), F.lit("internal"))).when(F.col("size") % 3 == 1, F.array(F.lit("internal")))
    either = predicates.documented_raw(F.when(F.col("size") % 5 == 0, F.lit("text")).when(F.col("size") % 5 == 1, F.lit("")), F.when(F.col("size") % 4 != 0, F.lit("about")))
    return e.select("export_key", predicates.documented().alias("by_text"), predicates.documented_or_tagged("description", tags).alias("by_text_or_tag"), predicates.has_internal_tag(tags).alias("internal_tag"), F.array_join(predicates.parse_list(_pick("size", " a, b,,a ", "a", " , ", "x y,z ")), ",").alias("parsed"),
        predicates.executable_language(_pick("size", "TS", "js", "python", "tsx", None)).alias("executable"), predicates.gate("size", F.lit(20), F.when(F.col("size") % 2 == 0, F.lit(True)).otherwise(F.col("size") % 7 == 0)).alias("passes"), predicates.category(_pick("size", "param-mismatch", "prose-import", "broken-link", "example-syntax")).alias("category"), either.alias("by_either"))


# -- doc comments


def _comments(spark, sf) -> DataFrame:
    e = spread(derive(spark, sf, "exports"))
    text = F.concat(
        F.lit("/**\n * Makes a "), "name", F.lit(".\n *\n * @param {"), _pick("size", "string", "{a: {b: c}}", "Map<a, b>"), F.lit("} "), F.when(F.col("size") % 2 == 0, F.concat(F.lit("[opt="), F.col("size").cast("string"), F.lit("]"))).otherwise(F.lit("must")), F.lit(" - about it\n * @arg second\n"),
        F.lit(" * @return {Promise<x>} what comes\n * @throws {"), "kind", F.lit("} now and then\n * @exception RangeError too far\n * @example Title line\n * ```ts\n * f("), F.col("size").cast("string"), F.lit(")\n * // @param no tag\n * ```\n * @see "), "spec_id", F.lit("\n */"),
    )
    return e.select("export_key", doc_comments.parse_comment(text).alias("c"))


@query("comment_params", f"""SELECT export_key, unnest([0, 1]) AS pos, unnest([CASE WHEN size % 2 = 0 THEN 'opt' ELSE 'must' END, 'second']) AS name, unnest([{_case("size", "string", "{a: {b: c}}", "Map<a, b>")}, NULL]) AS type, unnest([size % 2 = 0, false]) AS optional,
unnest([CASE WHEN size % 2 = 0 THEN CAST(size AS VARCHAR) END, NULL]) AS default_value, unnest(['about it', '']) AS description FROM exports""", "exports")
def _(spark, sf):
    return _comments(spark, sf).select("export_key", F.posexplode("c.params").alias("pos", "p")).select("export_key", "pos", "p.*")


@query("comment_parts", """SELECT export_key, concat('Makes a ', name, '.') AS description, 'Promise<x>' AS returns_type, 'what comes' AS returns_text, concat(kind, ',RangeError') AS throws, concat('Title line|ts|f(', size, ')', chr(10), '// @param no tag') AS example, 'param,param,returns,throws,throws,example,see' AS tags FROM exports""", "exports")
def _(spark, sf):
    c = _comments(spark, sf)
    x = F.element_at("c.examples", 1)
    return c.select("export_key", "c.description", F.col("c.returns.type").alias("returns_type"), F.col("c.returns.description").alias("returns_text"), F.array_join(F.transform("c.throws", lambda t: t["type"]), ",").alias("throws"), F.concat_ws("|", x["title"], x["language"], x["code"]).alias("example"), F.array_join(F.transform("c.tags", lambda t: t["name"]), ",").alias("tags"))
