"""Queries of the catalogue over smaller operators: entries, names, positions, retention, sources of any kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import api
from .catalogue import _DIFF, _key_tables, _KEYS, _versions, query, table
from .catalogue_files import _folder, _single
from .operators import findings, keys, predicates, registry, versions
from .plans.surface import derive
from .sinks import render
from .sources import files, truth


@query("all_type_keys", f"WITH {_KEYS.format(s='VARCHAR')} SELECT DISTINCT key FROM code")
def _(spark, sf):
    return keys.all_type_keys(_key_tables(spark, sf)[0])


@query("filter_presence", "SELECT export_key, size % 3 <> 2 AS filtered FROM exports", "exports")
def _(spark, sf):
    some, none = F.array(F.lit("a")), F.array().cast("array<string>")
    k = F.col("size") % 3
    return derive(spark, sf, "exports").select("export_key", predicates.has_filters(F.when(k == 0, some).otherwise(none), F.when(k == 1, some), none).alias("filtered"))


_TYPE_NAMES = ["T", "__type", "Promise", "HTMLDivElement", "Uint8Array", "MouseEvent", "Widget", "TT", "string", None]


@query("builtin_names", "SELECT export_key, size % 10 IN (0, 1, 2, 3, 4, 5, 8) AS builtin FROM exports", "exports")
def _(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in _TYPE_NAMES]), (F.col("size") % 10 + 1).cast("int"))
    return derive(spark, sf, "exports").select("export_key", predicates.builtin_type_name(name).alias("builtin"))


@query("builtin_methods", "SELECT export_key, CASE size % 3 WHEN 0 THEN 'run' ELSE 'gone' END AS method FROM exports WHERE size % 3 <> 1", "exports")
def _(spark, sf):
    """Calls that aren't of a built-in method."""
    k = F.col("size") % 3
    calls = derive(spark, sf, "exports").select("export_key", F.when(k == 0, "run").when(k == 1, "flatMap").otherwise("gone").alias("name"))
    return calls.join(predicates.builtin_methods(spark), "name", "left_anti").select("export_key", F.col("name").alias("method"))


@query("distinct_changes", "SELECT class, member, kind AS change, min(version_key) AS pos FROM members GROUP BY 1, 2, 3", "members")
def _(spark, sf):
    m = derive(spark, sf, "members").select("class", "member", F.col("kind").alias("change"), F.col("version_key").alias("pos"))
    return versions.distinct_changes(m)


@query("change_kinds", _DIFF + "SELECT id, CASE WHEN reason = 'removed' THEN 'removed' ELSE 'signature-changed' END AS kind FROM diff WHERE change = 'breaking'", "exports")
def _(spark, sf):
    old, new = _versions(spark, sf)
    return versions.change_kind(versions.spec_diff(old, new), new.select(F.col("id").alias("name")))


@query("equal_signatures", "SELECT export_key, size % 4 IN (0, 3) AS same FROM exports", "exports")
def _(spark, sf):
    """Equality of JSON text: another order of keys is another signature."""
    k = F.col("size") % 4
    a = F.when(k < 3, '{"a":1,"b":2}')
    b = F.when(k == 0, '{"a":1,"b":2}').when(k == 1, '{"b":2,"a":1}')
    return derive(spark, sf, "exports").select("export_key", versions.signatures_equal(a, b).alias("same"))


@query("entry_lookup", "SELECT DISTINCT n.name, coalesce((SELECT arg_min(export_key, export_pos) FROM exports e WHERE e.name = n.name AND size % 2 = 0), (SELECT arg_min(export_key, export_pos) FROM exports e WHERE e.name = n.name AND size % 3 = 0)) AS export_key, CASE WHEN n.name IN (SELECT name FROM exports WHERE size % 2 = 0) THEN 'export' WHEN n.name IN (SELECT name FROM exports WHERE size % 3 = 0) THEN 'type' END AS place FROM (SELECT name FROM exports UNION SELECT 'nowhere') n", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    wanted = e.select("name").unionByName(spark.createDataFrame([("nowhere",)], "name string"))
    return registry.find_entry(wanted, e.where("size % 2 = 0"), e.where("size % 3 = 0"))


_EXAMPLES = "x AS (SELECT spec_id, name, export_key, export_pos, unnest(CASE WHEN size % 2 = 0 THEN [0, 1] ELSE [0] END) AS ex_pos FROM exports), i AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY export_pos, ex_pos) - 1 AS index FROM x)"


def _examples(spark, sf):
    e = derive(spark, sf, "exports")
    return e.select("spec_id", "name", "export_key", "export_pos", F.explode(F.when(F.col("size") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("ex_pos"))


@query("example_positions", f"WITH {_EXAMPLES} SELECT spec_id, export_key, ex_pos, CAST(index AS INT) AS index FROM i", "exports")
def _(spark, sf):
    return findings.example_positions(_examples(spark, sf)).select("spec_id", "export_key", "ex_pos", "index")


@query("example_errors", f"WITH {_EXAMPLES}, f AS (SELECT spec_id, name, arg_min(export_key, export_pos) AS export_key FROM x GROUP BY 1, 2) SELECT i.spec_id, CAST(i.index AS INT) AS index, i.name, i.ex_pos, f.export_key, 'TS2304' AS code FROM i JOIN f ON f.spec_id = i.spec_id AND f.name = i.name WHERE i.index % 3 = 0", "exports")
def _(spark, sf):
    """Errors that a checker reports by the number of the example, back at their export."""
    x = _examples(spark, sf)
    errors = findings.example_positions(x).where("index % 3 = 0").select("spec_id", "index", F.lit("TS2304").alias("code"))
    return findings.placed_errors(errors, x).select("spec_id", "index", "name", "ex_pos", "export_key", "code")


@query("snapshots_pruned", "SELECT concat('s', lpad(CAST(n_nationkey AS VARCHAR), 3, '0'), '.json') AS file, (SELECT count(*) - 7 FROM nation) AS removed FROM nation ORDER BY file DESC LIMIT 7")
def _(spark, sf):
    path = _folder(spark, "snapshots")
    n = table(spark, sf, "nation")
    _single(n.select(F.concat(F.lit("s"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(".json")).alias("name"), F.lit("{}").alias("value")), path)
    gone = files.prune(spark, path, 7)
    return spark.createDataFrame([(name, gone) for name in files.Folder(spark, path).names()], "file string, removed bigint")


@query("report_saved", "SELECT spec_id, CAST(count(*) AS INT) AS exports FROM exports GROUP BY spec_id", "exports")
def _(spark, sf):
    path = _folder(spark, "report")
    files.save_report(derive(spark, sf, "exports").groupBy("spec_id").agg(F.count("*").cast("int").alias("exports")), path)
    return files.report(spark, path, "spec_id string, exports int")


@query("entry_points", """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'src/index.ts' WHEN 1 THEN 'code/main.ts' WHEN 2 THEN 'lib/a.d.ts' WHEN 3 THEN 'src/mod.ts' WHEN 4 THEN 'src/x.mts' END AS path,
CASE n_nationkey % 6 WHEN 0 THEN 'types' WHEN 1 THEN 'main' WHEN 2 THEN 'exports' WHEN 3 THEN 'fallback' WHEN 4 THEN 'module' END AS source, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey % 6 = 2 END AS declaration_only FROM nation""")
def _(spark, sf):
    """Sources behind what manifests declare: by the compiler's folders, by usual ones, a declaration file, usual places."""
    k = F.col("n_nationkey") % 6
    on = lambda n, v: F.when(k == n, v)
    there = F.when(k == 0, F.array(F.lit("src/index.ts"), F.lit("dist/index.d.ts"))).when(k == 1, F.array(F.lit("code/main.ts"))).when(k == 2, F.array(F.lit("lib/a.d.ts"))).when(k == 3, F.array(F.lit("src/mod.ts"))).when(k == 4, F.array(F.lit("src/x.mts"))).otherwise(F.array(F.lit("README.md")))
    fields = {"types": on(0, "./dist/index.d.ts"), "exports": on(2, "./lib/a.d.ts"), "main": on(1, "bin/main.js"), "module": on(4, "esm/x.mjs")}
    p = files.entry_point(fields, there, on(1, "./bin/"), on(1, "code"))
    return table(spark, sf, "nation").select("n_nationkey", p.alias("p")).select("n_nationkey", "p.path", "p.source", "p.declaration_only")


@query("any_source", """SELECT 'surface' AS spec_id, name, kind, 'typescript' AS lang FROM exports UNION ALL SELECT 'pets', concat('op', n_nationkey), 'function', 'openapi' FROM nation UNION ALL SELECT concat('c', s_suppkey), 'balances', 'map', 'clarity' FROM supplier""", "exports")
def _(spark, sf):
    """Spec files, a REST document and contracts as one table of exports."""
    spec, rest = _folder(spark, "spec"), _folder(spark, "rest")
    e = derive(spark, sf, "exports")
    render.write_spec(e.select(F.lit("surface").alias("spec_id"), F.col("export_pos").cast("int").alias("export_pos"), F.col("export_key").alias("id"), "name", "kind", "description"), spec)
    op = F.concat(F.lit('"/n'), F.col("n_nationkey").cast("string"), F.lit('":{"get":{"operationId":"op'), F.col("n_nationkey").cast("string"), F.lit('"}}'))
    doc = table(spark, sf, "nation").agg(F.array_join(F.collect_list(op), ",").alias("p")).select(F.lit("pets.v1.json").alias("name"), F.concat(F.lit('{"openapi":"3.0.0","paths":{'), F.col("p"), F.lit("}}")).alias("value"))
    _single(doc, rest)
    abis = table(spark, sf, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("contract"), F.lit('{"functions":[{"name":"hidden","access":"private"}],"maps":[{"name":"balances"}]}').alias("abi"))
    return truth.load(spark, [spec], [f"{rest}/pets.v1.json"], abis).select("spec_id", "name", "kind", "lang")


@query("capabilities", "SELECT unnest(['" + "', '".join(sorted(api.COMMANDS)) + "']) AS name")
def _(spark, sf):
    return spark.createDataFrame([(c["name"],) for c in api.capabilities()], "name string")
