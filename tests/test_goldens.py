"""Known results of single operators."""

from __future__ import annotations

import json

import pytest
from doclattice import catalogue
from doclattice.functions import scalars as S
from doclattice.operators import findings, fuzzy, history, keys, predicates, prose, registry, scoring, versions
from doclattice.sources import code_facts, contracts, doc_comments, files, markdown, rest_documents
from doclattice.sinks import render
from doclattice.streaming import history_stream
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


# -- scores


@pytest.mark.parametrize(("coverage", "exports", "issues", "score", "accuracy"), [(85, 24, 4, 78, 92), (70, 20, 2, 67, 95), (50, 20, 10, 38, 75), (40, 20, 3, 37, 93), (80, 12, 100, 40, 50), (100, 5, 20, 50, 50)])
def test_health_by_issues(spark, coverage, exports, issues, score, accuracy):
    r = one(spark, **scoring.health_by_issues(F.lit(coverage), F.lit(exports), F.lit(issues)))
    assert (r.score, r.accuracy) == (score, accuracy)


@pytest.mark.parametrize(("total", "documented", "with_issues", "health"), [(10, 5, 0, 75), (10, 10, 5, 75), (0, 0, 0, 100), (10, 10, 2, 90)])
def test_health_by_exports(spark, total, documented, with_issues, health):
    assert one(spark, h=scoring.health_by_exports(F.lit(total), F.lit(documented), F.lit(with_issues))).h == health


def test_weighted_health(spark):
    df = spark.createDataFrame([(100, 90, 90, 3, 90), (50, 30, 60, 4, 60)], "exports int, documented int, health int, issues int, coverage int")
    assert tuple(scoring.weighted_health(df).first()) == (150, 120, 7, 80, 80)
    assert scoring.weighted_health(df.limit(0)).first().health == 0


def test_rounding_goes_up(spark):
    assert [r.x for r in spark.createDataFrame([(-2.5,), (2.5,), (-0.4,)], "v double").select(S.half_up("v").alias("x")).collect()] == [-2, 3, 0]


# -- text


def test_camel_words(spark):
    assert one(spark, w=S.camel_words(F.lit("parseHTMLString"))).w == ["parse", "html", "string"]


def test_scalars(spark):
    r = one(
        spark, a=S.trim(F.lit("\n x\t")), b=S.unwrap_promise(F.lit("promise<A<B>>")), c=S.normalize_type(F.lit("Map < K ,  V >")), d=S.types_equivalent(F.lit("void"), F.lit("Undefined")), e=S.schema_type(F.lit('{"$ref":"#/types/Foo"}')), f=S.braces_type(F.lit(" { T } x")), g=S.template_tag(F.lit("T extends C<D> - why")), h=S.parse_replacement(F.lit("Use `next` instead.")), i=S.key_token(F.lit("a.b")), j=S.unescape_pointer(F.lit("a~1b~0c")), k=S.escape_property(F.lit("a:b,%\n")), l=S.link_targets(F.lit("{@link A.b | x} {@see C}")), m=S.render_links(F.lit("see {@link A | the a} and {@link B}")), n=S.error_line(F.lit("at x\nTypeError: no\nat y")), o=S.repository(F.lit("git+https://github.com/o/r.git")), p=S.duration_text(F.lit(61000)), q=S.strip_fence(F.lit("```ts\nx\n```")), r=S.has_plain_comment(F.lit("x // => 1")), s=S.sparkline(F.array(F.lit(0), F.lit(50), F.lit(100))), t=S.week_start(F.lit("2024-01-10")), u=S.context_snippet(F.lit("a\nfoo()\nb\nc"), F.lit("foo")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("x", "A<B>", "Map<K , V>", True, "Foo", "T")
    assert (r.g.name, r.g.constraint, r.h, r.i, r.j, r.k) == ("T", "C<D>", "next", "a", "a/b~c", "a%3Ab%2C%25%0A")
    assert (r.l, r.m, r.n, r.o.owner, r.o.repo, r.p) == (["A.b", "C"], "see the a and B", "TypeError: no", "o", "r", "1m 1s")
    assert (r.q, r.r, r.s, str(r.t), r.u) == ("x", False, "▁▅█", "2024-01-07", "a\nfoo()\nb")


# -- names


@pytest.mark.parametrize(("source", "candidates", "want"), [("fetchUser", ["fetchUserData", "createUser", "deleteData"], "fetchUserData"), ("getUserById", ["getUserByName", "setUserById"], "getUserByName"), ("createUsr", ["createUser"], None), ("foo", ["foo"], None), ("foo", [], None)])
def test_closest(spark, source, candidates, want):
    c = spark.createDataFrame([(x, i) for i, x in enumerate(candidates)], "candidate string, pos int")
    got = fuzzy.closest(spark.createDataFrame([(source,)], "source string"), c).collect()
    assert [r.candidate for r in got] == ([want] if want else [])


def test_search_scores(spark):
    names = ["createUser", "createUserTwo", "recreateUser", "creatUser", "other"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(fuzzy.search_score(F.lit("createuser"), "n").alias("s")).collect()]
    assert got == [100, 90, 70, 40, 0]


# -- versions

OLD = [("add", "function", "s", "d"), ("multiply", "function", "s", "d"), ("Point", "interface", "s", "d")]
NEW = [("add", "function", "s", "d"), ("subtract", "function", "s", "d"), ("Point", "interface", "s", "e")]
SPEC = "id string, kind string, shape string, docs string"


def test_spec_diff(spark):
    old, new = spark.createDataFrame(OLD, SPEC), spark.createDataFrame(NEW, SPEC)
    diff = versions.spec_diff(old, new)
    assert {(r.id, r.change) for r in diff.collect()} == {("multiply", "breaking"), ("subtract", "added"), ("Point", "docs-only")}
    assert [(r.id, r.severity, r.reason) for r in versions.breaking_severity(diff).collect()] == [("multiply", "high", "removed")]
    assert versions.semver_bump(diff).first().bump == "major"
    assert versions.semver_bump(versions.spec_diff(old.where("id <> 'multiply'"), new)).first().bump == "minor"
    assert versions.semver_bump(versions.spec_diff(old, old)).first().bump == "none"
    assert one(spark, v=versions.next_version(F.lit("1.2.3-rc.1"), F.lit("minor"))).v == "1.3.0"
    text = render.changelog(diff, "1.2.3", "major").first().value
    assert text.startswith("## 2.0.0\n\n### Breaking\n\n- multiply") and "- subtract" in text


def test_member_diff_suggests_a_rename(spark):
    ddl = "class string, member string, pos int, kind string, signature string"
    old = spark.createDataFrame([("C", "getUser", 0, "method", "()"), ("C", "same", 1, "method", "()"), ("C", "changed", 2, "method", "()")], ddl)
    new = spark.createDataFrame([("C", "fetchUser", 0, "method", "()"), ("C", "same", 1, "method", "()"), ("C", "changed", 2, "method", "(a)")], ddl)
    got = {(r.member, r.change, r.suggestion) for r in versions.member_diff(old, new).collect()}
    assert got == {("getUser", "removed", "fetchUser"), ("fetchUser", "added", None), ("changed", "signature-changed", None)}


# -- keys and Markdown

PAGE = """# Page
`mentioned` here

## Options

| Option | Text |
|---|---|
| `realOption` | x `no` |
| `ghostOption.deep` | x |
| plain | x |

```md
## Not a heading
| `fenced` | x |
```

### Nested

| `nested` | x |

## After

| `late` | x |
"""


def test_documented_keys(spark):
    pages = spark.createDataFrame([("p.md", PAGE)], "path string, content string")
    assert sorted(r.key for r in markdown.documented_keys(pages, "(?i)^options").collect()) == ["ghostOption", "nested", "realOption"]
    assert "mentioned" in {r.key for r in markdown.mentions(pages).collect()}
    assert [(r.level, r.title) for r in markdown.headings(pages).orderBy("line").collect()] == [(1, "Page"), (2, "Options"), (3, "Nested"), (2, "After")]


def test_key_coverage_gate(spark):
    code = spark.createDataFrame([("p", "realOption", False, None, False), ("p", "missingOption", False, None, False), ("p", "secretKey", False, None, False), ("p", "personalApiKey", True, "use secretKey instead", False), ("p", "_inner", False, None, False)], "page string, key string, deprecated boolean, reason string, internal boolean")
    doc = spark.createDataFrame([("p", "realOption"), ("p", "personalApiKey"), ("p", "ghostOption")], "page string, key string")
    cov = keys.key_coverage(code, doc, code.select("key"))
    assert {r.key: r.status for r in cov.collect()} == {"realOption": "documented", "personalApiKey": "documented", "ghostOption": "ghost", "missingOption": "user-facing", "secretKey": "user-facing", "_inner": "internal"}
    assert [(r.key, r.replacement) for r in keys.inversions(cov).collect()] == [("personalApiKey", "secretKey")]
    gate = keys.page_gate(cov, spark.createDataFrame([("p", 2)], "page string, baseline bigint")).first()
    assert (gate.ghosts, gate.gaps, gate.inversions, gate.status) == (1, 2, 1, "fail")
    lowered = keys.lowered_baselines(spark.createDataFrame([("p", 5), ("q", 1)], "page string, baseline bigint"), spark.createDataFrame([("p", 2), ("r", 3)], "page string, gaps bigint"))
    assert {tuple(r) for r in lowered.collect()} == {("p", 2), ("q", 1), ("r", 3)}


def test_code_blocks(spark):
    text = "a\n```ts title\nx\ny\n```\n```text\nno\n```\n```js\nz\n```\n"
    got = markdown.code_blocks(spark.createDataFrame([("p", text)], "path string, content string")).orderBy("block").collect()
    assert [(r.lang, r.meta, r.code, r.line_start, r.line_end) for r in got] == [("ts", "title", "x\ny", 2, 5), ("js", "", "z", 9, 11)]


# -- code

SNIPPET = """import def, { a as b, type T } from 'pkg'
import * as ns from "other"
import 'side'
const client = await createClient({ key: value })
const { x, y } = use()
client.items.list(1)
client.run()
new Thing()
items.map((item, i) => item.go())
// ignored.call()
const s = 'str.call()'
"""


def test_snippet_facts():
    facts = code_facts.snippet_facts(SNIPPET)
    pick = lambda kind: [f[1] for f in facts if f[0] == kind]
    assert [(f[1], f[2], f[3], f[4]) for f in facts if f[0] == "import"] == [("def", "def", "pkg", "default"), ("a", "b", "pkg", "named"), ("T", "T", "pkg", "named"), ("*" if False else "ns", "ns", "other", "namespace"), ("", None, "side", "side-effect")]
    assert {"client", "x", "y", "s"} <= set(pick("local")) and set(pick("param")) == {"item", "i"}
    assert ("client", "createClient") in [(f[1], f[2]) for f in facts if f[0] == "derived"]
    assert [(f[2], f[1]) for f in facts if f[0] == "method"] == [("client.items", "list"), ("client", "run"), ("items", "map"), ("item", "go")]
    assert pick("new") == ["Thing"] and "createClient" in pick("call") and not pick("error")
    assert code_facts.syntax_error("f({") == "unclosed {" and code_facts.syntax_error("a]") and code_facts.syntax_error("'x")
    assert [f[5] for f in facts if f[0] == "method"] == [5, 6, 8, 8]


def test_prose(spark):
    blocks = spark.createDataFrame([("p", 1, "import { good, bad } from 'pkg'\nimport { App } from 'ext'\nconst c = make()\nconst app = new App()", 10), ("p", 2, "c.known()\nc.lost()\napp.get()\nfree.thing()\nc.old()", 20)], "path string, block int, code string, line_start int")
    facts = code_facts.facts(blocks)
    names = spark.createDataFrame([("good",), ("make",)], "name string")
    assert [(r.target, r.line) for r in prose.broken_imports(facts, names, "pkg").collect()] == [("bad", 10)]
    builders = spark.createDataFrame([("make", "Client")], "name string, gives string")
    members = spark.createDataFrame([("Client", "known", False), ("Client", "old", True), ("Other", "old", False)], "class string, member string, deprecated boolean")
    builtins = spark.createDataFrame([("map",)], "name string")
    lost = prose.unresolved_members(facts, "pkg", names, members, builders, builtins)
    assert {r.target for r in lost.collect()} == {"c.lost", "free.thing"}
    old = prose.deprecated_references(facts, "pkg", spark.createDataFrame([("good", "use better")], "name string, note string"), registry.member_owners(members), builders, members)
    assert {(r.target, r.note) for r in old.collect()} == {("good", "use better"), ("old", "")}


def test_doc_comments(spark):
    text = "/**\n * Adds {@link x}.\n * @param {Map<{a: b}>} [n=1] - the number\n * @param m plain\n * @returns {number} sum\n * @throws {Error} never\n * @example Title here\n * ```ts\n * add(1) // => 2\n * ```\n * @deprecated old\n */"
    r = spark.createDataFrame([(text,), (None,)], "t string").select(doc_comments.parse_comment("t").alias("c")).collect()
    c = r[0].c
    assert c.description == "Adds {@link x}." and c.params[0].asDict() == {"name": "n", "type": "Map<{a: b}>", "optional": True, "default_value": "1", "description": "the number"}
    assert (c.params[1].name, c.params[1].description, c.returns.type, c.throws[0].type) == ("m", "plain", "number", "Error")
    assert (c.examples[0].title, c.examples[0].language, c.examples[0].code) == ("Title here", "ts", "add(1) // => 2")
    assert r[1].c.description is None and [t.name for t in c.tags][-1] == "deprecated"


# -- documents



def obj(**properties):
    return {"type": "object", "properties": properties}


def content(media, schema):
    return {"content": {media: {"schema": schema}}}


REF = "#/components/schemas/"
PET = obj(owner={"$ref": REF + "Owner"}, self={"$ref": REF + "Pet"})
BODY = obj(name={"type": "string"}, age={"type": "integer"}) | {"required": ["name"]}
LIST = {"summary": "List", "description": "All pets", "parameters": [{"in": "query", "name": "limit", "schema": {"type": "integer"}}], "responses": {"204": {}, "200": content("text/json", {"type": "array"})}}
ADD = {"operationId": "add", "requestBody": content("application/json", BODY), "responses": {"default": {}}}
REST = {"openapi": "3.1.0", "paths": {"/pets": {"parameters": [{"in": "query", "name": "limit", "required": True}], "get": LIST, "post": ADD}}, "components": {"schemas": dict(Pet=PET, Owner=obj())}}


def test_rest_document(spark):
    docs = spark.createDataFrame([("a", json.dumps(REST)), ("b", '{"swagger":"2.0"}'), ("c", "no json")], "doc string, content string")
    parsed = rest_documents.parse(docs)
    ops = rest_documents.operations(parsed)
    got = {r.name: r for r in ops.collect()}
    assert set(got) == {"GET /pets", "add"} and got["GET /pets"].description == "All pets" and got["GET /pets"].summary_tag == "List"
    params = {(r.name, r.required, r.place) for r in rest_documents.parameters(ops).collect()}
    assert params == {("limit", False, "query"), ("limit", True, "query"), ("name", True, "body"), ("age", False, "body")}
    assert {(r.code, r.schema_json) for r in rest_documents.responses(ops).collect()} == {("200", '{"type":"array"}'), ("default", '"void"')}
    types = {r.name: json.loads(r.schema_json) for r in rest_documents.types(parsed).collect()}
    assert types["Pet"]["properties"]["owner"]["title"] == "Owner" and types["Pet"]["properties"]["self"] == PET["properties"]["self"]
    refs = spark.createDataFrame([("a", "#/components/schemas/Owner"), ("a", "#/components/schemas/Nope")], "doc string, ref string")
    assert {r.ref[-4:]: r.node_json is not None for r in rest_documents.resolve(refs, rest_documents.pointers(parsed)).collect()} == {"wner": True, "Nope": False}
    assert rest_documents.display_type({"anyOf": [dict(type="array", items=PET["properties"]["self"]), {"type": "null"}]}) == "Pet[] | null"


def test_operations_leave_the_names_of_other_paths_behind(spark):
    paths = {f"/long/path/number/{k:05d}": {"get": {"operationId": f"op{k}", "parameters": [{"in": "query", "name": "q"}]}} for k in range(500)}
    docs = spark.createDataFrame([("a", json.dumps({"openapi": "3.0.0", "paths": paths}))], "doc string, content string")
    ops = rest_documents.operations(rest_documents.parse(docs))
    rows = ops.orderBy("export_pos").collect()
    assert [r.name for r in rows] == [f"op{k}" for k in range(500)]
    assert max(len(v.value) + len(v.metadata) for r in rows for v in (r.item, r.op)) < 300
    assert rest_documents.parameters(ops).count() == 500


def test_contract_types():
    assert contracts.type_schema({"optional": {"list": {"type": "uint128", "length": 3}}}) == {"anyOf": [{"type": "array", "items": "uint", "maxItems": 3}, {"type": "null"}]}
    assert contracts.type_schema({"response": {"ok": "bool", "error": {"tuple": [{"name": "a", "type": {"string-ascii": {"length": 5}}}]}}})["error"]["properties"]["a"]["encoding"] == "ascii"
    assert contracts.type_schema({"x": 1, "y": 2}) == "unknown"


# -- the rest


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y")], "src string, dst string")
    got = registry.reachable(edges, spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("x",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_deprecation_context(spark):
    lines = spark.createDataFrame([("p", k, "now Deprecated" if k == 30 else "x") for k in range(1, 80)], "path string, line bigint, text string")
    spans = spark.createDataFrame([("p", 24, 24), ("p", 25, 26), ("p", 35, 36), ("p", 36, 40), ("q", 30, 30)], "path string, start bigint, end bigint")
    assert {(r.path, r.start) for r in findings.near_deprecation(spans, lines).collect()} == {("p", 24), ("p", 36), ("q", 30)}


def test_selection(spark):
    e = spark.createDataFrame([("s", "k1", "Alpha", ["beta"]), ("s", "k2", "Beta", ["internal"]), ("s", "k3", "Gamma", [])], "spec_id string, export_key string, name string, tag_names array<string>")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    pick = lambda *a, **k: sorted(r.name for r in predicates.select_exports(e, *a, **k).collect())
    assert pick() == ["Alpha", "Beta", "Gamma"] and pick(rows(" alpha", "K3")) == ["Alpha", "Gamma"] and pick(rows("alpha"), rows("ALPHA")) == []
    assert pick(visibility=["public"]) == ["Gamma"] and pick(e.limit(0).select("name")) == ["Alpha", "Beta", "Gamma"]
    assert [r.name for r in predicates.missing_names(rows("alpha", "zeta"), e).collect()] == ["zeta"]


def test_log_reader_and_ratchet(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"date":"2024-01-01","package":"a","coverage":80,"lint":0}\nbroken\n{"date":"2024-01-02","package":"a","coverage":70,"lint":1}\n')
    log = files.history_log(spark, str(tmp_path / "h.jsonl"))
    assert log.count() == 2
    r = history.ratchet(log, 60).first()
    assert (r.watermark, r.reached, r.minimum) == (80, "2024-01-01", 80)
    assert history.ratchet(log, 90).first().minimum == 90 and history.ratchet(log.limit(0), 50).first().minimum == 50
    assert [tuple(x) for x in history.attention(history.package_trends(log), 50).collect()] == [("a", 70, 1)]


def test_docs_map_errors(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(dict(version=1, pages=[dict(page="a", type="T", baselineGaps=1), dict(page="", type="T", baselineGaps=-1, annotations={"x": "odd"})])))
    got = files.docs_map(spark, str(tmp_path / "m.json")).orderBy("page_pos").collect()
    assert got[0].errors == [] and got[1].errors == ["page is missing", "baselineGaps is negative", "unknown annotation"]


def test_partial_results(spark, tmp_path):
    (tmp_path / "p.ndjson").write_text('{"type":"header","total":3}\n{"type":"result","id":"a","score":1}\nbad\n{"type":"result","id":"b","score":2}\n')
    rows, state = files.partial_results(spark, str(tmp_path / "p.ndjson"))
    assert rows.count() == 2 and tuple(state.first()) == (3, 2, True)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2024-01-02T00:00:00", "a", 10), ("2024-01-03T00:00:00", "a", 21), ("2024-01-09T00:00:00", "a", 50), ("2024-03-01T00:00:00", "a", 1)]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"ts": t, "package": p, "coverage": c, "lint": 0}) for t, p, c in rows))
    q = history_stream.write_weekly(history_stream.weekly_rollup(history_stream.read_log(spark, str(tmp_path / "in")), "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("week").collect()
    assert [(str(r.week), r.average, r.snapshots) for r in got] == [("2023-12-31", 16, 2), ("2024-01-07", 50, 1)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_are_resolved_without_a_broadcast_of_nodes(spark):
    known = spark.createDataFrame([("a", "#/components/schemas/B", "{}")], "doc string, pointer string, node_json string")
    refs = spark.createDataFrame([("a", "#/components/schemas/B"), ("a", "#/x")], "doc string, ref string")
    out = rest_documents.resolve(refs, known)
    assert {tuple(r) for r in out.collect()} == {("a", "#/components/schemas/B", "{}"), ("a", "#/x", None)}
    assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)


def test_comments_are_parsed_once_and_on_all_cores(spark, tmp_path):
    spark.createDataFrame([(k, "big ring", "b", "PROMO", k) for k in range(4)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = catalogue.queries()["comment_params"](spark, str(tmp_path))
    assert plan(out).count("ArrowEvalPython") == 1 and "RoundRobinPartitioning" in plan(out).partition("ArrowEvalPython")[2]
    assert out.count() == 8


def test_parameters_find_what_the_single_detectors_find(spark):
    params = [("e", 2, 1, "a", "string", True), ("e", 1, 2, "a", None, None), ("e", 1, 3, "a.b", " Array < x > ", False), ("e", 1, 4, None, "x", True), ("e", 1, 5, "v", "void", False), (None, 1, 1, "a", "x", True)]
    docs = [("e", 1, "a", "number", False), ("e", 2, "a", " string ", True), ("e", 3, "a.b", "Array<x>", True), ("e", 4, "a.b", "Array<y>", None), ("e", 5, "a.c", "z", True), ("e", 6, "z.b", "z", True), ("e", 7, None, "z", True), ("e", 8, "v", "Undefined", True), ("e", 9, "v", " ", False), ("e", 10, ".a", None, True), (None, 1, "a", "y", False), ("f", 1, "a", "y", False), ("e", 1, "a", "number", False)]
    p = spark.createDataFrame(params, "export_key string, sig_pos int, param_pos int, name string, type string, required boolean")
    d = spark.createDataFrame(docs, "export_key string, tag_pos int, name string, type string, optional boolean")
    rows = lambda df: sorted(map(repr, df.select(*findings.COLUMNS).collect()))
    want = findings.param_names(p, d).unionByName(findings.optionality(p, d)).unionByName(findings.param_types(p, d))
    assert len(rows(want)) == 10 and rows(findings.parameters(p, d)) == rows(want)
    with_properties = p.withColumn("properties", F.array(F.lit("q")))
    assert ("e", "a.c") in {(r.export_key, r.target) for r in findings.parameters(with_properties, d).where("type = 'param-mismatch'").collect()}


def test_blanks_of_types(spark):
    r = one(spark, **{f"t{k}": S.normalize_type(F.lit(t)) for k, t in enumerate(["a<b>", " a < b > ", "", "  ", "a\u00a0", "a\n b"])}, p=S.present(F.lit(" \n")), q=S.present(F.lit(" x\n")), n=S.present(F.lit(None).cast("string")))
    assert tuple(r) == ("a<b>", "a<b>", "", "", "a\u00a0", "a b", False, True, False)


def test_a_lint_run_reads_parameters_once(spark, tmp_path):
    spark.createDataFrame([(1, "big ring", "b", "PROMO", 3)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, 1, 1, k, 5.0, 0.1, "A", "O") for k in range(1, 8)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = catalogue.queries()["all_findings"](spark, str(tmp_path))
    assert sum("FileScan" in line and "l_linenumber" in line for line in plan(out).splitlines()) == 2
