"""The catalogue of queries over the driver's tables, with the SQL that they must agree with.

Each query derives its part of an API surface (``plans.surface``) and applies operators to all
of it; its SQL says the same in a comparison engine's words over the same derivation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from . import storage
from .operators import findings, fuzzy, history, keys, predicates, prose, registry, scoring, versions
from .plans.surface import derive, with_derived
from .sinks import render
from .sources import code_facts, contracts, markdown, rest_documents
from .streaming import history_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: SQL without the derived tables, and their names.
_RAW: dict[str, tuple[str, tuple[str, ...]]] = {}

_DOC = "coalesce(length(regexp_replace(description, '^\\s+|\\s+$', '', 'g')) > 0, false)"
_NOT_EXTERNAL = "NOT (source_package IS NOT NULL AND source_file IS NULL)"
_PCT = "CASE WHEN {w} > 0 THEN CAST(floor(100.0::DOUBLE * {p} / {w} + 0.5) AS INT) ELSE 100 END"


def query(name: str, sql: str | None = None, *derived: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _RAW[name] = sql.strip(), derived
            _SQL[name] = with_derived(sql, *derived) if derived else sql.strip()
        return f

    return register


def _all() -> None:
    """Register the queries of the other modules, too."""
    from . import catalogue_code, catalogue_files, catalogue_support, catalogue_text  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a small file would be one task, however long its rows take."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


# -- coverage and health


@query("doc_coverage_by_package", f"SELECT spec_id, count(*) AS exports, count(*) FILTER ({_DOC}) AS documented, {_PCT.format(p=f'count(*) FILTER ({_DOC})', w='count(*)')} AS score FROM exports WHERE {_NOT_EXTERNAL} GROUP BY spec_id", "exports")
def _(spark, sf):
    return scoring.package_coverage(derive(spark, sf, "exports"))


@query("coverage_rollup", f"SELECT spec_id, count(*) AS exports, count(*) FILTER ({_DOC}) AS documented, {_PCT.format(p=f'count(*) FILTER ({_DOC})', w='count(*)')} AS score FROM exports WHERE {_NOT_EXTERNAL} GROUP BY ROLLUP (spec_id)", "exports")
def _(spark, sf):
    return scoring.coverage_rollup(derive(spark, sf, "exports"))


def _scored(spark, sf) -> DataFrame:
    e = derive(spark, sf, "exports")
    first = derive(spark, sf, "params").where("sig_pos = 1").groupBy("export_key").agg(F.count("*").alias("n_params"))
    docs = derive(spark, sf, "doc_params").where("optional").groupBy("export_key").agg(F.count("*").alias("n_doc_params"))
    r = derive(spark, sf, "returns")
    df = e.join(first, "export_key", "left").join(docs, "export_key", "left").join(r, "export_key", "left").fillna(0, ["n_params", "n_doc_params"])
    df = df.withColumn("n_doc_params", F.least("n_doc_params", "n_params"))
    df = df.withColumns({"has_returns": F.col("actual_type").isNotNull(), "doc_returns": F.col("doc_type").isNotNull(), "n_throws": F.col("size") % 3, "doc_throws": F.col("size") % 2 == 0, "has_example": F.col("size") % 6 != 0, "issues": (F.col("size") % 3).cast("bigint")})
    return scoring.export_score(df.where(~F.col("internal") & ~predicates.is_external()), scoring.requirements("verbose"))


_SCORED = f"""
WITH base AS (
  SELECT e.*, coalesce(p.n, 0) AS n_params, least(coalesce(d.n, 0), coalesce(p.n, 0)) AS n_doc, r.actual_type IS NOT NULL AS has_r, coalesce(r.doc_type IS NOT NULL, false) AS doc_r, {_DOC} AS ok
  FROM exports e LEFT JOIN (SELECT export_key, count(*) AS n FROM params WHERE sig_pos = 1 GROUP BY 1) p USING (export_key)
  LEFT JOIN (SELECT export_key, count(*) AS n FROM doc_params WHERE optional GROUP BY 1) d USING (export_key) LEFT JOIN returns r USING (export_key)
  WHERE NOT internal AND {_NOT_EXTERNAL}),
parts AS (
  SELECT *, kind IN ('function', 'class') AND n_params > 0 AS takes, kind = 'function' AND has_r AS gives, size % 3 > 0 AS throws FROM base),
pts AS (
  SELECT *, 30 + CASE WHEN takes THEN 25 ELSE 0 END + CASE WHEN gives THEN 20 ELSE 0 END + CASE WHEN throws THEN 10 ELSE 0 END + 15 AS most,
    CASE WHEN ok THEN 30 ELSE 0 END + CASE WHEN takes THEN CASE WHEN n_doc >= n_params THEN 25 ELSE CAST(floor(25.0::DOUBLE * n_doc / n_params + 0.5) AS INT) END ELSE 0 END
    + CASE WHEN gives AND doc_r THEN 20 ELSE 0 END + CASE WHEN throws AND size % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN size % 6 <> 0 THEN 15 ELSE 0 END AS got FROM parts),
scored AS (
  SELECT spec_id, name, export_key, export_pos, size % 3 AS issues, CAST(floor(100.0::DOUBLE * got / most + 0.5) AS INT) AS score,
    list_filter([CASE WHEN NOT ok THEN 'description' END, CASE WHEN takes AND n_doc < n_params THEN 'params' END, CASE WHEN gives AND NOT doc_r THEN 'returns' END, CASE WHEN throws AND size % 2 <> 0 THEN 'throws' END, CASE WHEN size % 6 = 0 THEN 'examples' END], lambda x: x IS NOT NULL) AS missing FROM pts)
"""


@query("export_score", _SCORED + "SELECT export_key, score, array_to_string(missing, ',') AS missing FROM scored", "exports", "params", "doc_params", "returns")
def _(spark, sf):
    return _scored(spark, sf).select("export_key", "score", F.array_join("missing", ",").alias("missing"))


_ROLLED = _SCORED.rstrip() + """,
rolled AS (
  SELECT spec_id, name, arg_max(export_key, score * 1000000000::BIGINT - export_pos) AS export_key, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(missing)))), ',') AS missing, CAST(sum(issues) AS BIGINT) AS issues, count(*) AS overloads
  FROM scored GROUP BY spec_id, name)
"""


@query("overload_rollup", _ROLLED + "SELECT * FROM rolled", "exports", "params", "doc_params", "returns")
def _(spark, sf):
    return scoring.overload_rollup(_scored(spark, sf)).withColumn("missing", F.array_join("missing", ","))


@query("spec_totals", _ROLLED + "SELECT spec_id, count(*) AS total, count(*) FILTER (missing = '') AS complete, CAST(sum(issues) AS BIGINT) AS issues, CAST(floor(avg(score) + 0.5) AS INT) AS score FROM rolled GROUP BY spec_id", "exports", "params", "doc_params", "returns")
def _(spark, sf):
    return scoring.spec_totals(scoring.overload_rollup(_scored(spark, sf)))


@query("missing_pivot", _ROLLED + "SELECT spec_id, " + ", ".join(f"count(*) FILTER (contains(missing, '{r}')) AS no_{r}" for r in scoring.RULES) + " FROM rolled GROUP BY spec_id", "exports", "params", "doc_params", "returns")
def _(spark, sf):
    return scoring.missing_pivot(scoring.overload_rollup(_scored(spark, sf)))


_PACKAGES = f"""
WITH cov AS (SELECT spec_id, count(*) AS exports, count(*) FILTER ({_DOC}) AS documented, count(*) FILTER (deprecated <> tag_deprecated) AS issues FROM exports WHERE {_NOT_EXTERNAL} GROUP BY spec_id)
"""


def _packages(spark, sf) -> DataFrame:
    e = derive(spark, sf, "exports").where(~predicates.is_external())
    return e.groupBy("spec_id").agg(F.count("*").alias("exports"), F.count_if(predicates.documented()).alias("documented"), F.count_if(F.col("deprecated") != F.col("tag_deprecated")).alias("issues"))


@query("health_by_issues", _PACKAGES + """, c AS (SELECT *, CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT) AS coverage, least(0.5::DOUBLE * issues / exports, 0.5::DOUBLE) AS p FROM cov)
SELECT spec_id, coverage AS completeness, CAST(floor(100 * (1 - p) + 0.5) AS INT) AS accuracy, CAST(floor(coverage * (1 - p) * (1 - 0.3::DOUBLE * (100 - CAST(floor(100.0::DOUBLE * 3 / 4 + 0.5) AS INT)) / 100) + 0.5) AS INT) AS score FROM c""", "exports")
def _(spark, sf):
    df = _packages(spark, sf).withColumn("coverage", S.percent("documented", "exports"))
    h = scoring.health_by_issues("coverage", "exports", "issues", F.lit(3), F.lit(4))
    return df.select("spec_id", *[h[k].alias(k) for k in ("completeness", "accuracy", "score")])


@query("health_by_exports", _PACKAGES + """SELECT spec_id, CAST(floor(0.5::DOUBLE * CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT) + 0.5::DOUBLE * CASE WHEN documented > 0 THEN CAST(floor(100.0::DOUBLE * greatest(0, documented - issues) / documented + 0.5) AS INT) ELSE 100 END + 0.5) AS INT) AS health FROM cov""", "exports")
def _(spark, sf):
    return _packages(spark, sf).select("spec_id", scoring.health_by_exports("exports", "documented", "issues").alias("health"))


@query("package_weighted_health", _PACKAGES + """, c AS (SELECT *, CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT) AS coverage, exports % 100 AS health FROM cov)
SELECT CAST(sum(exports) AS BIGINT) AS exports, CAST(sum(documented) AS BIGINT) AS documented, CAST(sum(issues) AS BIGINT) AS issues, CAST(floor(sum(health::DOUBLE * exports) / sum(exports) + 0.5) AS INT) AS health, CAST(floor(sum(coverage::DOUBLE * exports) / sum(exports) + 0.5) AS INT) AS coverage FROM c""", "exports")
def _(spark, sf):
    return scoring.weighted_health(_packages(spark, sf).withColumns({"coverage": S.percent("documented", "exports"), "health": F.col("exports") % 100}))


@query("batch_scan", _PACKAGES + f"""SELECT c.spec_id, c.exports, c.documented, CAST(floor(100.0::DOUBLE * c.documented / c.exports + 0.5) AS INT) AS score, coalesce(i.issues, 0) AS issues, coalesce(i.issues, 0) AS with_issues,
CAST(floor(0.5::DOUBLE * CAST(floor(100.0::DOUBLE * c.documented / c.exports + 0.5) AS INT) + 0.5::DOUBLE * CASE WHEN c.documented > 0 THEN CAST(floor(100.0::DOUBLE * greatest(0, c.documented - coalesce(i.issues, 0)) / c.documented + 0.5) AS INT) ELSE 100 END + 0.5) AS INT) AS health,
CAST(floor(0.5::DOUBLE * CAST(floor(100.0::DOUBLE * c.documented / c.exports + 0.5) AS INT) + 0.5::DOUBLE * CASE WHEN c.documented > 0 THEN CAST(floor(100.0::DOUBLE * greatest(0, c.documented - coalesce(i.issues, 0)) / c.documented + 0.5) AS INT) ELSE 100 END + 0.5) AS INT) >= 75 AS passes
FROM cov c LEFT JOIN (SELECT spec_id, count(*) AS issues FROM exports WHERE deprecated <> tag_deprecated GROUP BY 1) i USING (spec_id)""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    issues = findings.deprecation(e).join(e.select("spec_id", "export_key"), "export_key")
    return scoring.batch_scan(scoring.package_coverage(e), issues, 75)


@query("initial_threshold", _PACKAGES + "SELECT greatest(0, min(CAST(floor(100.0::DOUBLE * documented / exports + 0.5) AS INT)) - 5) AS threshold FROM cov", "exports")
def _(spark, sf):
    return scoring.initial_threshold(scoring.package_coverage(derive(spark, sf, "exports")))


@query("example_presence", "SELECT spec_id, count(*) AS total, count(*) FILTER (size % 6 <> 0) AS with_examples, array_to_string(list_sort(coalesce(list(name) FILTER (size % 6 = 0), [])), ',') AS missing FROM exports GROUP BY spec_id", "exports")
def _(spark, sf):
    return scoring.example_presence(derive(spark, sf, "exports").withColumn("has_example", F.col("size") % 6 != 0)).withColumn("missing", F.array_join("missing", ","))


@query("stored_coverage", f"SELECT CAST(floor(avg(coalesce(CASE WHEN size % 2 = 0 THEN size::DOUBLE END, CASE WHEN {_DOC} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)) + 0.5) AS INT) AS coverage FROM exports", "exports")
def _(spark, sf):
    return scoring.stored_coverage(derive(spark, sf, "exports").withColumn("stored_score", F.when(F.col("size") % 2 == 0, F.col("size"))))


@query("release_readiness", _PACKAGES + """, x AS (SELECT (SELECT CAST(floor(100.0::DOUBLE * sum(documented) / sum(exports) + 0.5) AS INT) FROM cov) AS coverage, (SELECT count(*) FROM exports WHERE deprecated <> tag_deprecated) AS issues, (SELECT array_to_string(list_sort(list(name)), ',') FROM (SELECT name FROM exports WHERE NOT """ + _DOC + """ ORDER BY name LIMIT 10)) AS undocumented)
SELECT coverage, issues, undocumented, array_to_string(list_filter([CASE WHEN coverage < 90 THEN concat('coverage ', coverage, ' below 90') END, CASE WHEN issues > 0 THEN concat(issues, ' issues') END], lambda r: r IS NOT NULL), '; ') AS reasons, coverage >= 90 AND issues = 0 AS ready FROM x""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    out = scoring.release_readiness(scoring.package_coverage(e), findings.deprecation(e), e.where(~predicates.documented()), 90)
    return out.withColumns({"reasons": F.array_join("reasons", "; "), "undocumented": F.array_join("undocumented", ",")})


@query("surface_completeness", f"""WITH r AS (SELECT DISTINCT p_brand AS spec_id, concat(upper(substr(p_name, 1, 1)), split_part(p_name, ' ', 2)) AS name FROM part), x AS (SELECT spec_id, name FROM exports WHERE size > 10), f AS (SELECT spec_id, count(*) AS forgotten FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.spec_id = r.spec_id AND lower(x.name) = lower(r.name)) AND name NOT LIKE 'R%' GROUP BY 1)
SELECT n.spec_id, exported, coalesce(forgotten, 0) AS forgotten, CAST(floor(100.0::DOUBLE * exported / (exported + coalesce(forgotten, 0)) + 0.5) AS INT) AS completeness FROM (SELECT spec_id, count(DISTINCT lower(name)) AS exported FROM x GROUP BY 1) n LEFT JOIN f USING (spec_id)""", "exports")
def _(spark, sf):
    r = table(spark, sf, "part").select(F.col("p_brand").alias("spec_id"), F.lower(F.concat(F.upper(F.substring("p_name", 1, 1)), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("name"))
    x = derive(spark, sf, "exports").where("size > 10").select("spec_id", F.lower("name").alias("name"))
    return scoring.surface_completeness(r, x, r.where("name LIKE 'r%'").select("name").distinct())


# -- detectors

_F = "export_key, type, target, expected, actual, suggestion"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '\\s*<\\s*', '<', 'g'), '\\s*>', '>', 'g'))"
_SAME = f"({_NORM.format(x='{a}')} = {_NORM.format(x='{b}')} OR (lower({_NORM.format(x='{a}')}) IN ('void', 'undefined') AND lower({_NORM.format(x='{b}')}) IN ('void', 'undefined')))"
_NULLS = "CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS suggestion"


@query("param_name_mismatch", f"SELECT d.export_key, 'param-mismatch' AS type, d.name AS target, {_NULLS} FROM doc_params d WHERE NOT EXISTS (SELECT 1 FROM params p WHERE p.export_key = d.export_key AND p.name = split_part(d.name, '.', 1))", "params", "doc_params")
def _(spark, sf):
    return findings.param_names(derive(spark, sf, "params"), derive(spark, sf, "doc_params"))


_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY export_key, name ORDER BY sig_pos, param_pos) AS n FROM params) t WHERE n = 1"
_OPT = "CASE WHEN {c} THEN 'optional' ELSE 'required' END"


@query("optionality_mismatch", f"SELECT d.export_key, 'optionality-mismatch' AS type, d.name AS target, {_OPT.format(c='NOT p.required')} AS expected, {_OPT.format(c='d.optional')} AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM doc_params d JOIN ({_FIRST}) p ON p.export_key = d.export_key AND p.name = d.name WHERE d.optional <> (NOT p.required)", "params", "doc_params")
def _(spark, sf):
    return findings.optionality(derive(spark, sf, "params"), derive(spark, sf, "doc_params"))


@query("param_type_mismatch", f"SELECT d.export_key, 'param-type-mismatch' AS type, d.name AS target, {_NORM.format(x='p.type')} AS expected, {_NORM.format(x='d.type')} AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM doc_params d JOIN ({_FIRST}) p ON p.export_key = d.export_key AND p.name = d.name WHERE d.type IS NOT NULL AND NOT {_SAME.format(a='d.type', b='p.type')}", "params", "doc_params")
def _(spark, sf):
    return findings.param_types(derive(spark, sf, "params"), derive(spark, sf, "doc_params"))


_ACT, _DOCP = "lower(actual_type) LIKE 'promise<%'", "lower(doc_type) LIKE 'promise<%'"


@query("return_type_mismatch", f"SELECT export_key, 'return-type-mismatch' AS type, 'returns' AS target, {_NORM.format(x='actual_type')} AS expected, {_NORM.format(x='doc_type')} AS actual, CASE WHEN {_ACT} AND NOT {_DOCP} THEN 'the value is wrapped in a promise' WHEN NOT {_ACT} AND {_DOCP} THEN 'the value isn''t wrapped in a promise' END AS suggestion FROM returns WHERE doc_type IS NOT NULL AND NOT {_SAME.format(a='doc_type', b='actual_type')}", "returns")
def _(spark, sf):
    return findings.return_types(derive(spark, sf, "returns"))


_GEN = "SELECT export_key, pos, name, CASE WHEN size % 3 = 0 THEN NULL ELSE concat('C', CAST((size + {k}) % 4 AS {s})) END AS c FROM (SELECT export_key, size, 1 AS pos, concat('T', CAST(size % 5 AS {s})) AS name FROM exports) t"


@query("generic_constraint_mismatch", f"WITH a AS ({_GEN.format(k=0, s='VARCHAR')}), d AS (SELECT export_key, name, CASE WHEN pos % 2 = 1 AND right(export_key, 1) IN ('1', '3') THEN concat(coalesce(c, ''), 'x') ELSE c END AS c FROM a) SELECT d.export_key, 'generic-constraint-mismatch' AS type, d.name AS target, a.c AS expected, d.c AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM d JOIN a ON a.export_key = d.export_key AND a.name = d.name WHERE d.c IS DISTINCT FROM a.c", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    a = e.select("export_key", F.lit(1).alias("pos"), F.concat(F.lit("T"), (F.col("size") % 5).cast("string")).alias("name"), F.when(F.col("size") % 3 != 0, F.concat(F.lit("C"), (F.col("size") % 4).cast("string"))).alias("constraint"))
    d = a.withColumn("constraint", F.when(F.substring("export_key", -1, 1).isin("1", "3"), F.concat(F.coalesce("constraint", F.lit("")), F.lit("x"))).otherwise(F.col("constraint")))
    return findings.generic_constraints(a, d)


@query("property_type_mismatch", """SELECT concat(class, member) AS export_key, 'property-type-mismatch' AS type, member AS target, kind AS expected, CASE WHEN version_key % 2 = 0 THEN 'method' ELSE 'property' END AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM members WHERE kind <> CASE WHEN version_key % 2 = 0 THEN 'method' ELSE 'property' END""", "members")
def _(spark, sf):
    m = derive(spark, sf, "members").select(F.concat("class", "member").alias("export_key"), F.col("member").alias("name"), F.col("kind").alias("type"), F.when(F.col("version_key") % 2 == 0, "{method} text").otherwise(" { property } text").alias("tag_text"))
    return findings.property_types(m)


@query("deprecated_mismatch", f"SELECT export_key, 'deprecated-mismatch' AS type, name AS target, CASE WHEN deprecated THEN 'deprecated' ELSE 'current' END AS expected, CASE WHEN tag_deprecated THEN 'deprecated' ELSE 'current' END AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM exports WHERE deprecated <> tag_deprecated", "exports")
def _(spark, sf):
    return findings.deprecation(derive(spark, sf, "exports"))


@query("visibility_mismatch", "WITH i AS (SELECT export_key, name, CASE size % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'public' WHEN 2 THEN 'private' WHEN 3 THEN 'internal' END AS doc, CASE WHEN size % 7 < 3 THEN 'private' ELSE 'public' END AS code FROM exports) SELECT export_key, 'visibility-mismatch' AS type, name AS target, code AS expected, doc AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM i WHERE doc IS NOT NULL AND NOT CASE WHEN doc = 'internal' THEN code <> 'public' ELSE doc = code END", "exports")
def _(spark, sf):
    tag = F.when(F.col("size") % 5 == 0, "internal").when(F.col("size") % 5 == 1, "public").when(F.col("size") % 5 == 2, "private").when(F.col("size") % 5 == 3, "alpha")
    return findings.visibility(derive(spark, sf, "exports").select("export_key", F.col("name").alias("target"), F.array_compact(F.array(F.lit("see"), tag)).alias("tag_names"), F.when(F.col("size") % 7 < 3, "private").alias("actual")))


@query("async_mismatch", f"WITH x AS (SELECT *, {_ACT} AS c, coalesce(contains(lower(doc_type), 'promise'), false) OR async_tag AS d FROM returns) SELECT export_key, 'async-mismatch' AS type, 'returns' AS target, CASE WHEN c THEN 'async' ELSE 'sync' END AS expected, CASE WHEN d THEN 'async' ELSE 'sync' END AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM x WHERE (c AND NOT d AND doc_type IS NOT NULL) OR (NOT c AND d AND NOT async_flag)", "returns")
def _(spark, sf):
    return findings.asynchrony(derive(spark, sf, "returns"))


@query("broken_links", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS t FROM pages), w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS n FROM benchmark)
SELECT concat('p', page_id) AS export_key, 'broken-link' AS type, t AS target, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM a WHERE regexp_matches(t, '^[a-z]+$') AND t NOT IN (SELECT n FROM w)""")
def _(spark, sf):
    anchors = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("t")).where(F.col("t").rlike("^[a-z]+$"))
    texts = anchors.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("export_key"), F.concat(F.lit("see {@link "), F.col("t"), F.lit(" | label}")).alias("text"))
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]+)"), 1)).alias("name"))
    return findings.broken_links(texts, words)



@query("assertion_zip", """WITH u AS (SELECT conv_id, turn, len(string_split(text, chr(10))) AS n, string_split(text, chr(10)) AS l FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS o FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, unnest(generate_series(1, n)) AS j, l FROM u WHERE EXISTS (SELECT 1 FROM a WHERE a.conv_id = u.conv_id AND a.turn = u.turn)),
x AS (SELECT e.conv_id, e.turn, j, trim(l[j]) AS expected, o[j] AS actual FROM e JOIN a ON a.conv_id = e.conv_id AND a.turn = e.turn WHERE trim(l[j]) <> '')
SELECT concat('c', conv_id) AS export_key, 'example-assertion' AS type, concat('line ', j) AS target, expected, actual, CAST(NULL AS VARCHAR) AS suggestion FROM x WHERE actual IS NULL OR actual <> expected""")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("export_key", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    code = F.array_join(F.transform(F.split("text", "\n"), lambda v: F.concat(F.lit("f() // => "), v)), "\n")
    examples = c.where("role = 'user'").select("export_key", F.col("turn").alias("ex_pos"), code.alias("code"))
    results = c.where("role = 'assistant'").select("export_key", (F.col("turn") - 1).alias("ex_pos"), F.lit(True).alias("success"), F.col("text").alias("stdout"))
    return findings.failed_assertions(examples, results)


@query("runtime_failures", """SELECT concat('u', user_id) AS export_key, 'example-runtime' AS type, concat('example ', event_id) AS target, CAST(NULL AS VARCHAR) AS expected, CASE WHEN value > 20 THEN 'timeout' ELSE concat('TypeError: ', props) END AS actual, CAST(NULL AS VARCHAR) AS suggestion FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("export_key"), F.col("event_id").alias("ex_pos"), "event_type", "value", "props")
    results = e.select("export_key", "ex_pos", (F.col("event_type") != "error").alias("success"), F.when(F.col("value") > 20, "run timed out").otherwise(F.concat(F.lit("at x\n  TypeError: "), F.col("props"), F.lit("\nat y"))).alias("stderr"))
    return findings.runtime_failures(e.select("export_key", "ex_pos"), results)


@query("deprecation_context_range", """WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT doc_id, line FROM l WHERE contains(lower(t), 'thing')), f AS (SELECT doc_id, line AS s, line + 1 AS e FROM l WHERE line % 7 = 0)
SELECT concat('d', doc_id) AS path, s AS start, e AS "end" FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.line BETWEEN s - 5 AND e + 5)""")
def _(spark, sf):
    l = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("p", "t")).select("path", (F.col("p") + 1).cast("bigint").alias("line"), F.when(F.lower("t").contains("thing"), "deprecated").otherwise("").alias("text"))
    spans = l.where("line % 7 = 0").select("path", F.col("line").alias("start"), (F.col("line") + 1).alias("end"))
    return findings.near_deprecation(spans, l).select("path", "start", "end")


# -- names

_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\s_-]+'), lambda w: w <> '')"
_CLOSE = f"""
s AS (SELECT DISTINCT source FROM src), c AS (SELECT candidate, pos FROM cand),
pairs AS (SELECT source, candidate, pos FROM s JOIN c ON abs(length(source) - length(candidate)) <= 3 AND lower(source[1]) = lower(candidate[1])),
extra AS (SELECT source, candidate, pos FROM (SELECT source FROM s WHERE source NOT IN (SELECT source FROM pairs)) t, (SELECT * FROM c ORDER BY pos LIMIT 50) f),
w AS (SELECT *, {_WORDS.format(x='source')} AS a, {_WORDS.format(x='candidate')} AS b FROM (SELECT * FROM pairs UNION ALL SELECT * FROM extra)),
x AS (SELECT *, a[len(a)] = b[len(b)] AS suf FROM w),
y AS (SELECT *, (CASE WHEN suf THEN 1.5::DOUBLE ELSE 0::DOUBLE END + len(list_filter(a, lambda q: list_contains(b, q) AND NOT (suf AND q = a[len(a)])))) AS m FROM x),
z AS (SELECT *, m / greatest(len(a), len(b)) AS wt, 1 - levenshtein(lower(source), lower(candidate))::DOUBLE / greatest(length(source), length(candidate)) AS sp FROM y),
t AS (SELECT *, CASE WHEN suf THEN 1.5::DOUBLE * wt + sp ELSE wt + 0.5::DOUBLE * sp END AS total FROM z WHERE source <> candidate AND m >= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, pos) AS n FROM t WHERE total >= 0.5 AND wt >= CASE WHEN suf THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END)"""


@query("fuzzy_top1", f"""WITH src AS (SELECT DISTINCT concat(name, 'Big') AS source FROM exports), cand AS (SELECT concat(name, CASE WHEN min(size) % 2 = 0 THEN 'Big' ELSE 'Bag' END, 's') AS candidate, min(export_pos) AS pos FROM exports GROUP BY name), {_CLOSE}
SELECT source, candidate, floor(total * 1e6 + 0.5) / 1e6 AS score, CAST(floor(10 * (1 - total) + 0.5) AS INT) AS distance FROM best WHERE n = 1""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    src = e.select(F.concat("name", F.lit("Big")).alias("source")).distinct()
    cand = e.groupBy("name").agg(F.min("size").alias("s"), F.min("export_pos").alias("pos")).select(F.concat("name", F.when(F.col("s") % 2 == 0, "Big").otherwise("Bag"), F.lit("s")).alias("candidate"), "pos")
    out = fuzzy.closest(src, cand)
    return out.select("source", "candidate", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "distance")


@query("fuzzy_search_top3", """WITH q AS (SELECT unnest(['bolt', 'smallring', 'redwidgat', 'blu', 'ring']) AS query), i AS (SELECT name, min(export_pos) AS pos FROM exports GROUP BY name),
s AS (SELECT query, name, pos, CASE WHEN lower(name) = query THEN 100 WHEN starts_with(lower(name), query) THEN 90 WHEN contains(lower(name), query) THEN 70 WHEN abs(length(query) - length(name)) <= 3 AND levenshtein(query, lower(name)) <= 2 THEN 50 - 10 * levenshtein(query, lower(name)) ELSE 0 END AS score FROM q, i),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM s WHERE score > 0) SELECT query, CAST(rank AS INT) AS rank, name, CAST(score AS INT) AS score FROM r WHERE rank <= 3""", "exports")
def _(spark, sf):
    items = derive(spark, sf, "exports").groupBy("name").agg(F.min("export_pos").alias("pos"))
    return fuzzy.search(spark.createDataFrame([(x,) for x in ("bolt", "smallring", "redwidgat", "blu", "ring")], "query string"), items)


# -- versions

_OLD = "SELECT * FROM exports WHERE export_pos % 10 <> 1"
_NEW = "SELECT export_pos, export_key, kind, CASE WHEN export_pos % 7 = 0 THEN concat(name, '2') ELSE name END AS name, CASE WHEN export_pos % 3 = 0 THEN concat(coalesce(description, ''), '!') ELSE description END AS description, spec_id FROM exports WHERE export_pos % 10 <> 0"
_DIFF = f"""WITH o AS ({_OLD}), n AS ({_NEW}), d AS (SELECT coalesce(o.export_key, n.export_key) AS id, coalesce(o.spec_id, n.spec_id) AS spec_id, CASE WHEN n.export_key IS NULL THEN 'removed' WHEN o.export_key IS NULL THEN 'added' WHEN o.name <> n.name THEN 'changed' WHEN o.description IS DISTINCT FROM n.description THEN 'docs' END AS reason, coalesce(o.kind, n.kind) AS kind FROM o FULL JOIN n ON o.export_key = n.export_key),
diff AS (SELECT id, spec_id, CASE WHEN reason IN ('removed', 'changed') THEN 'breaking' WHEN reason = 'added' THEN 'added' ELSE 'docs-only' END AS change, reason, kind FROM d WHERE reason IS NOT NULL) """


def _versions(spark, sf):
    e = derive(spark, sf, "exports")
    old = e.where("export_pos % 10 <> 1").select(F.col("export_key").alias("id"), "kind", F.col("name").alias("shape"), F.col("description").alias("docs"), "spec_id")
    new = e.where("export_pos % 10 <> 0").select(F.col("export_key").alias("id"), "kind", F.when(F.col("export_pos") % 7 == 0, F.concat("name", F.lit("2"))).otherwise(F.col("name")).alias("shape"), F.when(F.col("export_pos") % 3 == 0, F.concat(F.coalesce("description", F.lit("")), F.lit("!"))).otherwise(F.col("description")).alias("docs"), "spec_id")
    return old, new


@query("spec_diff", _DIFF + "SELECT id, change, reason, kind FROM diff", "exports")
def _(spark, sf):
    return versions.spec_diff(*_versions(spark, sf))


@query("breaking_severity", _DIFF + ", s AS (SELECT id, kind, reason, CASE WHEN kind IN ('function', 'class') THEN 'high' WHEN kind IN ('interface', 'type', 'enum') THEN 'medium' ELSE 'low' END AS severity FROM diff WHERE change = 'breaking') SELECT *, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM s", "exports")
def _(spark, sf):
    return versions.breaking_severity(versions.spec_diff(*_versions(spark, sf)))


@query("semver_bump", _DIFF + ", c AS (SELECT spec_id, count(*) FILTER (change = 'breaking') AS breaking, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'docs-only') AS docs_only FROM diff GROUP BY spec_id) SELECT *, CASE WHEN breaking > 0 THEN 'major' WHEN added > 0 THEN 'minor' WHEN docs_only > 0 THEN 'patch' ELSE 'none' END AS bump FROM c", "exports")
def _(spark, sf):
    old, new = _versions(spark, sf)
    where = old.select("id", "spec_id").unionByName(new.select("id", "spec_id")).distinct()
    return versions.semver_bump(versions.spec_diff(old, new).join(where, "id"), ["spec_id"])


@query("member_diff", """WITH o AS (SELECT class, member, arg_max(kind, version_key) AS kind, arg_max(signature, version_key) AS sig FROM members WHERE version_key % 3 <> 0 GROUP BY 1, 2), n AS (SELECT class, member, arg_max(kind, version_key) AS kind, arg_max(signature, version_key) AS sig FROM members WHERE version_key % 3 <> 1 GROUP BY 1, 2),
d AS (SELECT coalesce(o.class, n.class) AS class, coalesce(o.member, n.member) AS member, coalesce(n.kind, o.kind) AS kind, CASE WHEN o.class IS NULL THEN 'added' WHEN n.class IS NULL THEN 'removed' WHEN o.sig <> n.sig THEN 'signature-changed' END AS change FROM o FULL JOIN n ON o.class = n.class AND o.member = n.member) SELECT * FROM d WHERE change IS NOT NULL""", "members")
def _(spark, sf):
    m = derive(spark, sf, "members").withColumn("pos", F.col("version_key"))
    return versions.member_diff(m.where("version_key % 3 <> 0"), m.where("version_key % 3 <> 1")).select("class", "member", "kind", "change")


@query("coverage_delta", """WITH o AS (SELECT export_key AS id, CASE WHEN size % 4 <> 0 THEN size END AS a FROM exports WHERE export_pos % 10 <> 1), n AS (SELECT export_key AS id, CASE WHEN size % 5 <> 0 THEN 2 * size - 20 END AS b FROM exports WHERE export_pos % 10 <> 0),
x AS (SELECT (SELECT CAST(floor(avg(coalesce(a, 0)) + 0.5) AS INT) FROM o) AS old_coverage, (SELECT CAST(floor(avg(coalesce(b, 0)) + 0.5) AS INT) FROM n) AS new_coverage, (SELECT count(*) FROM o JOIN n USING (id) WHERE b > a) AS improved, (SELECT count(*) FROM o JOIN n USING (id) WHERE b < a) AS regressed) SELECT *, new_coverage - old_coverage AS delta FROM x""", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    return versions.coverage_delta(e.where("export_pos % 10 <> 1").select(F.col("export_key").alias("id"), F.when(F.col("size") % 4 != 0, F.col("size")).alias("score")), e.where("export_pos % 10 <> 0").select(F.col("export_key").alias("id"), F.when(F.col("size") % 5 != 0, 2 * F.col("size") - 20).alias("score")))


@query("hash_diff", "WITH a AS (SELECT name AS path, substr(sha256(CAST(count(*) AS VARCHAR)), 1, 16) AS h FROM exports WHERE export_pos % 10 <> 1 GROUP BY 1), b AS (SELECT name AS path, substr(sha256(CAST(count(*) AS VARCHAR)), 1, 16) AS h FROM exports WHERE export_pos % 10 <> 0 GROUP BY 1) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.h IS NULL THEN 'removed' WHEN a.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    side = lambda k: e.where(f"export_pos % 10 <> {k}").groupBy(F.col("name").alias("path")).agg(S.content_hash(F.count("*").cast("string")).alias("hash"))
    return versions.hash_diff(side(1), side(0))


@query("new_undocumented", f"SELECT export_key AS id FROM exports WHERE export_pos % 10 = 1 AND NOT {_DOC}", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports").withColumnRenamed("export_key", "id")
    return versions.new_undocumented(e.where("export_pos % 10 <> 1"), e.where("export_pos % 10 <> 0"))


_FACTS = """f AS (SELECT concat('d', doc_id) AS path, 1 AS block, p AS pos, w AS name, CASE WHEN p % 5 = 0 THEN 'import' WHEN p % 5 = 1 THEN 'new' WHEN p % 5 = 2 THEN 'method' ELSE 'call' END AS fact, p % 50 AS line FROM (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))"""
_REFS = """r AS (SELECT path, block, pos, name, fact, line FROM f WHERE fact = 'import' AND name IN ({names}) UNION ALL SELECT path, block, pos, name, fact, line FROM (SELECT *, row_number() OVER (PARTITION BY path, block, name ORDER BY pos) AS n FROM f WHERE fact = 'call' AND name IN ({names})) t WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM f i WHERE i.fact = 'import' AND i.path = t.path AND i.block = t.block AND i.name = t.name))"""
_NAMES = ("was", "from", "this", "pour", "nicht")


def _facts(spark, sf) -> DataFrame:
    p = F.col("p")
    return table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", " ")).alias("q", "name")).withColumn("p", F.col("q") + 1).select("path", F.lit(1).alias("block"), p.cast("bigint").alias("pos"), "name", F.when(p % 5 == 0, "import").when(p % 5 == 1, "new").when(p % 5 == 2, "method").otherwise("call").alias("fact"), (p % 50).cast("bigint").alias("line"))


@query("export_references", f"WITH {_FACTS}, {_REFS.format(names=str(_NAMES)[1:-1])} SELECT * FROM r")
def _(spark, sf):
    return versions.export_references(_facts(spark, sf), spark.createDataFrame([(n,) for n in _NAMES], "name string"))


@query("docs_impact", f"""WITH {_FACTS}, {_REFS.format(names="'was', 'pour'")}, i AS (
SELECT DISTINCT path, block, name, 'removed' AS change, 'call' AS via FROM f WHERE fact = 'method' AND name = 'with' UNION ALL SELECT DISTINCT path, block, name, 'member', 'new' FROM f WHERE fact = 'new' AND name = 'from' UNION ALL SELECT DISTINCT path, block, name, 'changed', 'reference' FROM r) SELECT * FROM i""")
def _(spark, sf):
    changes = spark.createDataFrame([("from", "with", "removed")], "class string, member string, change string")
    changed = spark.createDataFrame([("was", "changed"), ("pour", "changed"), ("from", "changed")], "name string, change string")
    return versions.docs_impact(_facts(spark, sf), changes, changed).select("path", "block", "name", "change", "via")


@query("undocumented_names", "SELECT DISTINCT name FROM exports WHERE lower(name) NOT IN (SELECT lower(concat(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))) FROM part WHERE p_size > 48)", "exports")
def _(spark, sf):
    words = table(spark, sf, "part").where("p_size > 48").select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("word"))
    return versions.undocumented_names(derive(spark, sf, "exports"), words)


# -- registry and closure


@query("registry_members", "WITH p AS (SELECT member, class, bool_or(version_key % 2 = 0) AS d FROM members GROUP BY 1, 2) SELECT member, count(*) AS owners, count(*) FILTER (d) AS deprecated_in, count(*) = count(*) FILTER (d) AS deprecated_everywhere FROM p GROUP BY member", "members")
def _(spark, sf):
    return registry.member_owners(derive(spark, sf, "members").withColumn("deprecated", F.col("version_key") % 2 == 0))


@query("registry_names", "SELECT name FROM exports UNION SELECT export_key FROM exports UNION SELECT concat(class, '.', member) FROM members", "exports", "members")
def _(spark, sf):
    return registry.names(derive(spark, sf, "exports"), members=derive(spark, sf, "members"))


@query("module_graph", "SELECT name, arg_min(spec_id, CAST(substr(spec_id, 7) AS BIGINT) * 1000000000 + export_pos) AS module, count(DISTINCT spec_id) AS modules FROM exports GROUP BY name", "exports")
def _(spark, sf):
    return registry.module_graph(derive(spark, sf, "exports").withColumn("module_pos", F.expr("cast(substr(spec_id, 7) as int)")))


@query("type_closure", """WITH e AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM nation UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('r', s_suppkey % 2) FROM supplier)
SELECT node, CAST(min(depth) AS INT) AS depth FROM (WITH RECURSIVE t AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.node WHERE t.depth < 9 AND e.dst NOT IN ('n3')) SELECT * FROM t) x GROUP BY node""")
def _(spark, sf):
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    n, s, c = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    edges = n.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).union(s.select(key("n", "s_nationkey"), key("s", "s_suppkey"))).union(c.select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(s.select(key("s", "s_suppkey"), F.concat(F.lit("r"), (F.col("s_suppkey") % 2).cast("string"))))
    return registry.reachable(edges, spark.createDataFrame([("r1",)], "node string"), spark.createDataFrame([("n3",)], "node string"))


# -- keys

_KEYS = """code AS (SELECT p_brand AS page, concat('k', CAST(p_size AS {s})) AS key, max(p_partkey % 5 = 0) AS deprecated, max(concat('use k', CAST(p_size % 10 AS {s}), ' instead')) AS reason FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2), doc AS (SELECT DISTINCT p_brand AS page, concat('k', CAST(p_size + CASE WHEN p_partkey % 17 = 0 THEN 40 ELSE 0 END AS {s})) AS key FROM part WHERE p_partkey % 3 <> 1), men AS (SELECT DISTINCT p_brand AS page, concat('k', CAST(p_size AS {s})) AS key FROM part WHERE p_partkey % 11 = 0)"""
_COVERED = """cov AS (SELECT page, key, CASE WHEN c.key IS NOT NULL AND d.key IS NOT NULL THEN 'documented' WHEN c.key IS NULL AND key IN (SELECT key FROM code) THEN 'other-type' WHEN c.key IS NULL THEN 'ghost' WHEN m.key IS NOT NULL THEN 'prose-documented' WHEN deprecated THEN 'deprecated' ELSE 'user-facing' END AS status, coalesce(deprecated, false) AS deprecated, regexp_extract(reason, 'use (k[0-9]+)', 1) AS replacement
FROM (SELECT page, key FROM code UNION SELECT page, key FROM doc) a LEFT JOIN code c USING (page, key) LEFT JOIN doc d USING (page, key) LEFT JOIN men m USING (page, key)), inv AS (SELECT page, key, replacement FROM cov c WHERE status = 'documented' AND deprecated AND replacement IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cov d WHERE d.page = c.page AND d.key = c.replacement AND d.status = 'documented'))"""


def _key_tables(spark, sf):
    p = table(spark, sf, "part")
    k = lambda c: F.concat(F.lit("k"), c.cast("string")).alias("key")
    code = p.where("p_partkey % 3 <> 0").groupBy(F.col("p_brand").alias("page"), k(F.col("p_size"))).agg(F.max(F.col("p_partkey") % 5 == 0).alias("deprecated"), F.max(F.concat(F.lit("use k"), (F.col("p_size") % 10).cast("string"), F.lit(" instead"))).alias("reason")).withColumn("internal", F.lit(False))
    doc = p.where("p_partkey % 3 <> 1").select(F.col("p_brand").alias("page"), k(F.col("p_size") + F.when(F.col("p_partkey") % 17 == 0, 40).otherwise(0)))
    men = p.where("p_partkey % 11 = 0").select(F.col("p_brand").alias("page"), k(F.col("p_size")))
    return code, doc, men


@query("key_coverage", f"WITH {_KEYS.format(s='VARCHAR')}, {_COVERED} SELECT page, key, status, deprecated, replacement FROM cov")
def _(spark, sf):
    code, doc, men = _key_tables(spark, sf)
    return keys.key_coverage(code, doc, code.select("key"), men)


@query("key_inversions", f"WITH {_KEYS.format(s='VARCHAR')}, {_COVERED} SELECT * FROM inv")
def _(spark, sf):
    code, doc, men = _key_tables(spark, sf)
    return keys.inversions(keys.key_coverage(code, doc, code.select("key"), men))


@query("docs_map_gate", f"""WITH {_KEYS.format(s='VARCHAR')}, {_COVERED}, b AS (SELECT DISTINCT p_brand AS page, CAST(2 AS BIGINT) AS baseline FROM part WHERE p_brand LIKE '%1'),
g AS (SELECT page, count(*) FILTER (status = 'ghost') AS ghosts, count(*) FILTER (status = 'user-facing') AS gaps, count(*) FILTER (status = 'documented') AS documented FROM cov GROUP BY page)
SELECT g.*, coalesce(i.n, 0) AS inversions, coalesce(baseline, 0) AS baseline, CASE WHEN ghosts > 0 OR gaps > coalesce(baseline, 0) THEN 'fail' WHEN gaps > 0 OR coalesce(i.n, 0) > 0 THEN 'warn' ELSE 'pass' END AS status FROM g LEFT JOIN (SELECT page, count(*) AS n FROM inv GROUP BY 1) i USING (page) LEFT JOIN b USING (page)""")
def _(spark, sf):
    code, doc, men = _key_tables(spark, sf)
    base = code.where("page LIKE '%1'").select("page", F.lit(2).cast("bigint").alias("baseline")).distinct()
    return keys.page_gate(keys.key_coverage(code, doc, code.select("key"), men), base)


@query("docs_map_candidates", f"""WITH {_KEYS.format(s='VARCHAR')}, l AS (SELECT page FROM doc GROUP BY page HAVING count(*) >= 3), o AS (SELECT d.page, c.page AS type, count(*) AS overlap FROM doc d JOIN code c USING (key) WHERE d.page IN (SELECT page FROM l) GROUP BY 1, 2 HAVING count(*) >= 3) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY overlap DESC, type) AS INT) AS rank FROM o) t WHERE rank <= 3""")
def _(spark, sf):
    code, doc, _ = _key_tables(spark, sf)
    return keys.page_candidates(doc, code.select(F.col("page").alias("type"), "key"))


# -- history


@query("history_trend", """WITH r AS (SELECT *, lag(coverage) OVER (PARTITION BY package ORDER BY date, seq) AS prev, row_number() OVER (PARTITION BY package ORDER BY date DESC, seq DESC) AS age FROM history)
SELECT package, max(coverage) FILTER (age = 1) AS "current", max(coverage - prev) FILTER (age = 1) AS delta, array_to_string(list(coverage ORDER BY age DESC), ',') AS series FROM r WHERE age <= 10 GROUP BY package""", "history")
def _(spark, sf):
    return history.trend(derive(spark, sf, "history")).select("package", "current", "delta", F.array_join("series", ",").alias("series"))


@query("sparkline", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY date DESC, seq DESC) AS age FROM history), x AS (SELECT package, coverage, age, min(coverage) OVER w AS lo, max(coverage) OVER w AS hi FROM r WHERE age <= 10 WINDOW w AS (PARTITION BY package))
SELECT package, string_agg(substr('▁▂▃▄▅▆▇█', CAST(least(floor((coverage - lo)::DOUBLE / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 8), 7) AS INT) + 1, 1), '' ORDER BY age DESC) AS bars FROM x GROUP BY package""", "history")
def _(spark, sf):
    return history.trend(derive(spark, sf, "history")).select("package", "bars")


@query("history_velocity", """WITH r AS (SELECT event_type AS package, ts, event_id AS seq, CAST(least(100.0, floor(value)) AS INT) AS coverage FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS), a AS (SELECT package, count(*) AS n, date_diff('microsecond', min(ts), max(ts))::DOUBLE / 86400000000 AS d, arg_min(coverage, ts) AS c0, arg_max(coverage, ts) AS c1 FROM r GROUP BY package)
SELECT package, CASE WHEN n >= 2 AND d >= 1 THEN floor(100 * (c1 - c0)::DOUBLE / d + 0.5) / 100 ELSE 0 END AS velocity, c1 AS "current", CAST(least(100, greatest(0, floor(c1 + 30 * CASE WHEN n >= 2 AND d >= 1 THEN floor(100 * (c1 - c0)::DOUBLE / d + 0.5) / 100 ELSE 0 END + 0.5))) AS INT) AS projected FROM a""")
def _(spark, sf):
    h = table(spark, sf, "events").select(F.col("event_type").alias("package"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.least(F.lit(100.0), F.floor("value")).cast("int").alias("coverage"))
    return history.projection(history.velocity(h, "2024-01-30 00:00:00", 7))


@query("weekly_summary", """WITH w AS (SELECT *, date - CAST(dayofweek(date) AS INT) AS week FROM history) SELECT package, week, CAST(floor(avg(coverage) + 0.5) AS INT) AS average, arg_min(coverage, epoch(date) * 1000000 + seq) AS first, arg_max(coverage, epoch(date) * 1000000 + seq) AS last, count(*) AS snapshots, arg_max(coverage, epoch(date) * 1000000 + seq) - arg_min(coverage, epoch(date) * 1000000 + seq) AS delta FROM w GROUP BY package, week""", "history")
def _(spark, sf):
    return history.weekly(derive(spark, sf, "history"))


@query("ratchet_watermark", """WITH m AS (SELECT package, max(coverage) AS w FROM history GROUP BY package) SELECT m.package, w AS watermark, (SELECT min(date) FROM history h WHERE h.package = m.package AND coverage = w) AS reached, greatest(60, w) AS minimum FROM m""", "history")
def _(spark, sf):
    return history.ratchet(derive(spark, sf, "history"), 60, per_package=True)


_TREND = """t AS (SELECT package, arg_min(coverage, epoch(date) * 1000000 + seq) AS first, arg_max(coverage, epoch(date) * 1000000 + seq) AS last, arg_max(lint, epoch(date) * 1000000 + seq) AS lint FROM history GROUP BY package)"""


@query("package_trends", f"WITH {_TREND} SELECT *, last - first AS delta FROM t", "history")
def _(spark, sf):
    return history.package_trends(derive(spark, sf, "history")).select("package", "first", "last", "lint", "delta")


@query("attention_list", f"WITH {_TREND} SELECT package, last, lint FROM t WHERE last < 20 OR lint > 0", "history")
def _(spark, sf):
    return history.attention(history.package_trends(derive(spark, sf, "history")), 20)


@query("daily_average", "SELECT date, CAST(floor(avg(coverage) + 0.5) AS INT) AS average FROM history GROUP BY date", "history")
def _(spark, sf):
    return history.daily_average(derive(spark, sf, "history"))


@query("history_extremes", "SELECT package, max(coverage) AS best, min(coverage) AS worst, min(date) AS since, max(date) AS until FROM history GROUP BY package", "history")
def _(spark, sf):
    return history.extremes(derive(spark, sf, "history"))


@query("history_retained", "SELECT * FROM (SELECT seq, date, package, coverage, lint, CAST(row_number() OVER (PARTITION BY package ORDER BY date DESC, seq DESC) AS INT) AS n FROM history) t WHERE n <= 100", "history")
def _(spark, sf):
    w = Window.partitionBy("package").orderBy(F.col("date").desc(), F.col("seq").desc())
    return history.retained(derive(spark, sf, "history")).withColumn("n", F.row_number().over(w))


# -- filters


@query("filter_visibility", "SELECT spec_id, export_key, name FROM exports WHERE CASE WHEN internal THEN 'internal' WHEN size % 5 = 0 THEN 'beta' ELSE 'public' END IN ('public', 'beta')", "exports")
def _(spark, sf):
    tags = F.when(F.col("internal"), F.array(F.lit("internal"), F.lit("beta"))).when(F.col("size") % 5 == 0, F.array(F.lit("see"), F.lit("beta"))).otherwise(F.array(F.lit("see")))
    return predicates.select_exports(derive(spark, sf, "exports").withColumn("tag_names", tags), visibility=["public", "beta"]).select("spec_id", "export_key", "name")


@query("filter_include_exclude", "SELECT spec_id, export_key, name FROM exports WHERE (lower(name) IN ('smallring', 'bluebolt') OR export_key IN ('e7', 'e9')) AND lower(name) <> 'bluebolt'", "exports")
def _(spark, sf):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    return predicates.select_exports(derive(spark, sf, "exports"), rows(" SmallRing", "BLUEBOLT", "E7", "e9"), rows("blueBolt ")).select("spec_id", "export_key", "name")


@query("changed_packages", "SELECT DISTINCT p_brand AS dir FROM part WHERE p_size > 49")
def _(spark, sf):
    p = table(spark, sf, "part")
    files = p.where("p_size > 49").select(F.concat(F.col("p_brand"), F.lit("/src/"), F.col("p_name"), F.lit(".ts")).alias("path"))
    return predicates.changed_packages(p.select(F.col("p_brand").alias("dir")).distinct(), files)


# -- sources and renderings


def _rest_docs(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").withColumn("id", F.col("p_partkey").cast("string"))
    op = F.concat(F.lit('"/p/'), F.col("id"), F.lit('":{"parameters":[{"in":"path","name":"id","required":true}],"'), F.when(F.col("p_size") % 2 == 0, "get").otherwise("post"), F.lit('":{'), F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"operationId":"op'), F.col("id"), F.lit('",'))), F.lit('"summary":"'), F.col("p_name"), F.lit('","parameters":[{"in":"path","name":"id","required":false},{"in":"query","name":"q'), (F.col("p_size") % 4).cast("string"), F.lit('"}]}}'))
    docs = p.groupBy(F.col("p_brand").alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(op)), ",").alias("paths"))
    return docs.select("doc", F.concat(F.lit('{"openapi":"3.0.1","paths":{'), F.col("paths"), F.lit("}}")).alias("content"))


@query("rest_operations", "SELECT p_brand AS doc, CASE WHEN p_size % 3 = 0 THEN concat(CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END, ' /p/', p_partkey) ELSE concat('op', p_partkey) END AS name, p_name AS description, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/p/', p_partkey) AS path FROM part")
def _(spark, sf):
    return rest_documents.operations(rest_documents.parse(_rest_docs(spark, sf))).select("doc", "name", "description", "method", "path")


@query("rest_parameters", "SELECT p_brand AS doc, CASE WHEN p_size % 3 = 0 THEN concat(CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END, ' /p/', p_partkey) ELSE concat('op', p_partkey) END AS operation, unnest(['id', concat('q', p_size % 4)]) AS name, false AS required, CAST(unnest([1, 2]) AS INT) AS param_pos FROM part")
def _(spark, sf):
    ops = rest_documents.operations(rest_documents.parse(_rest_docs(spark, sf)))
    return rest_documents.parameters(ops).join(ops.select("doc", "export_pos", F.col("name").alias("operation")), ["doc", "export_pos"]).select("doc", "operation", "name", "required", "param_pos")


@query("contract_exports", "SELECT concat('c', s_suppkey) AS contract, unnest(['function', 'map', 'token']) AS kind, unnest([concat('f', s_nationkey), 'balances', s_name]) AS name, unnest([CASE WHEN s_nationkey % 2 = 0 THEN s_name END, NULL, NULL]) AS description FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("contract")
    abi = F.concat(F.lit('{"functions":[{"name":"f'), F.col("s_nationkey").cast("string"), F.lit('","access":"public","args":[]},{"name":"hidden","access":"private","args":[]}],"maps":[{"name":"balances"}],"fungible_tokens":[{"name":"'), F.col("s_name"), F.lit('"}]}'))
    docs = s.where("s_nationkey % 2 = 0").select(key, F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_name").alias("description"))
    return contracts.exports(s.select(key, abi.alias("abi")), docs).select("contract", "kind", "name", "description")


def _markdown(spark, sf) -> DataFrame:
    turn = F.when(F.col("role") == "user", F.concat(F.lit("```ts title\n"), F.col("text"), F.lit("\n```"))).otherwise(F.concat(F.lit("# heading\n"), F.col("text")))
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", turn.alias("t")).alias("s"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("content")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), "content")


@query("markdown_blocks", "SELECT concat('c', conv_id) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS block, 'ts' AS lang, 'title' AS meta, text AS code FROM conversations WHERE role = 'user'")
def _(spark, sf):
    return markdown.code_blocks(_markdown(spark, sf)).select("path", "block", "lang", "meta", "code")


@query("prose_imports", "SELECT concat('e', event_id) AS path, 1 AS block, 1 AS line, 'prose-import' AS type, event_type AS target FROM events WHERE event_type NOT IN ('view', 'click')")
def _(spark, sf):
    facts = code_facts.facts(spread(table(spark, sf, "events")).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), F.lit(1).alias("block"), F.concat(F.lit("import { "), F.col("event_type"), F.lit(" } from 'pkg/sub'\nimport x from 'other'")).alias("code"), F.lit(1).alias("line_start")))
    return prose.broken_imports(facts, spark.createDataFrame([("view",), ("click",)], "name string"), "pkg")


@query("doc_keys", "SELECT DISTINCT p_brand AS path, concat('k', p_size) AS key FROM part")
def _(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("| `k"), F.col("p_size").cast("string"), F.lit(".sub` or `other` | text `no` |")))), "\n").alias("t"))
    files = rows.select(F.col("p_brand").alias("path"), F.concat(F.lit("# Page\n| `outside` | x |\n## Options\n| key | text |\n|---|---|\n```\n# not a heading\n| `fenced` | x |\n```\n### Nested\n"), F.col("t"), F.lit("\n## After\n| `late` | x |\n")).alias("content"))
    return markdown.documented_keys(files, "(?i)^options$").select("path", "key").distinct()


@query("surface_markdown", f"""WITH l AS (SELECT spec_id, kind, list_position({list(render.KINDS)}, kind) AS r, string_agg(concat('- `', name, '`', CASE WHEN length(trim(description)) > 0 THEN concat(': ', trim(description)) ELSE '' END), chr(10) ORDER BY name, export_key) AS body FROM exports GROUP BY 1, 2)
SELECT spec_id, concat('# ', spec_id, chr(10), chr(10), string_agg(concat('## ', upper(kind[1]), kind[2:], chr(10), chr(10), body), concat(chr(10), chr(10)) ORDER BY r)) AS value FROM l GROUP BY spec_id""", "exports")
def _(spark, sf):
    return render.surface_markdown(derive(spark, sf, "exports"))


@query("annotations", "SELECT concat('::warning file=', replace(source_file, ':', '%3A'), ',line=', source_line, '::100%25 of ', name, '%0Aend') AS value FROM exports WHERE source_file IS NOT NULL", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports").where("source_file IS NOT NULL").select(F.concat(F.lit("./"), F.col("source_file")).alias("file"), F.col("source_line").alias("line"), F.concat(F.lit("100% of "), F.col("name"), F.lit("\nend")).alias("message"))
    return render.annotations(e)


@query("history_stream", "SELECT CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS week, event_type AS package, CAST(floor(avg(CAST(least(100.0, floor(value)) AS INT)) + 0.5) AS INT) AS average, max(CAST(least(100.0, floor(value)) AS INT)) AS best, count(*) AS snapshots FROM events GROUP BY 1, 2")
def _(spark, sf):
    """The log as a stream (an extension): weeks are appended as they close, those still open at its end are added."""
    root = f"{storage.shared_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    log = table(spark, sf, "events").select("ts", F.col("event_type").alias("package"), F.least(F.lit(100.0), F.floor("value")).cast("int").alias("coverage"), (F.col("user_id") % 4).cast("int").alias("lint"))
    log.write.json(f"{root}/log")
    done = history_stream.write_weekly(history_stream.weekly_rollup(history_stream.read_log(spark, f"{root}/log"), "1 day"), f"{root}/weeks", f"{root}/state")
    done.awaitTermination()
    weeks = spark.read.schema("week date, package string, average int, best int, snapshots bigint").parquet(f"{root}/weeks")
    return history_stream.finished(weeks, spark.read.schema(history_stream.SCHEMA).json(f"{root}/log").where("ts IS NOT NULL"))
