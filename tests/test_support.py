"""Configuration, caches, versions, runs and result checks."""

from __future__ import annotations

import json

import pytest
from doclattice import api, cache, config
from doclattice.operators import predicates, scoring, validation
from doclattice.sinks import render
from doclattice.sources import files, markdown, versions
from doclattice.streaming import runs
from pyspark.sql import functions as F


def test_config(tmp_path):
    assert config.errors({"minimum": 101, "style": "loud", "odd": 1, "lint": "yes"}) == ["unknown key odd", "lint must be bool", "minimum must be from 0 to 100", "style must be one of minimal, verbose, types-only"]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / config.FILE_NAMES[0]).write_text(json.dumps({"minimum": 70, "require": {"examples": True}}))
    found = config.find(tmp_path / "a" / "b")
    assert found.minimum == 70 and found.requirements() == {"description": True, "params": False, "returns": False, "examples": True}
    assert config.merge({"docs": {"map": "m"}}, {"docs": {"exclude": ["x"]}}).docs.exclude == ["x"]
    with pytest.raises(ValueError, match="minimum"):
        config.merge({"minimum": -1})
    c = config.with_value({"a": {"b": 1}}, "a.c.d", config.coerce("true"))
    assert config.nested(c, "a.c.d") is True and config.nested(c, "x.y", 5) == 5 and config.flatten(c) == [("a.b", 1), ("a.c.d", True)]
    assert config.validation_modes("run, presence") == ["presence", "run"] and config.validation_modes(True) == list(config.MODES) and config.validation_modes(None) == []
    with pytest.raises(ValueError, match="nope"):
        config.validation_modes("nope")


def test_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    name = cache.key("1", cache.source_fingerprint(files))
    assert name == cache.key("1", cache.source_fingerprint(files.orderBy(F.desc("path")))) and name != cache.key("1", cache.source_fingerprint(files.where("path = 'a'")))
    built = []
    for hit in (False, True):
        df, there = cache.cached(spark, name, lambda: built.append(1) or files, str(tmp_path))
        assert there is hit and df.count() == 2
    assert built == [1]
    state = cache.validity(F.lit(True), F.lit(True), F.lit(None).cast("boolean"), F.lit(True), F.lit(True), F.lit(False))
    assert spark.range(1).select(state.alias("s")).first().s == "config"


def test_versions(spark, tmp_path):
    old = spark.createDataFrame([("add", "function")], "id string, kind string")
    versions.save_version(old, str(tmp_path / "v"), "v1")
    versions.save_version(old.withColumn("kind", F.lit("class")), str(tmp_path / "v"), "v2")
    versions.save_version(old, str(tmp_path / "v"), "v1")
    a, b = versions.both_sides(spark, base="v1", head="v2", root=str(tmp_path / "v"))
    assert a.first().kind == "function" and b.first().kind == "class"
    with pytest.raises(ValueError, match="refs"):
        versions.both_sides(spark)


def test_resumable_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a"}\n{"id":"b"}\n')
    stream = spark.readStream.schema("id string").json(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        runs.start(stream, lambda b: b.withColumn("score", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 2
    wanted = spark.createDataFrame([("a",), ("c",)], "id string")
    assert [r.id for r in runs.remaining(wanted, done, ["id"]).collect()] == ["c"]


EXPORTS = "spec_id string, export_pos int, export_key string, name string, kind string, description string, deprecated boolean, tag_deprecated boolean, internal boolean, source_file string, source_package string, source_line int"
ROWS = [("s", 0, "k0", "alpha", "function", "text", False, False, False, "a.ts", None, 1), ("s", 1, "k1", "beta", "class", " ", True, False, False, "b.ts", None, 2), ("t", 0, "k2", "gamma", "type", None, False, False, False, None, "ext", 3)]


def test_commands(spark):
    s = api.Surface(spark.createDataFrame(ROWS, EXPORTS))
    scan = api.scan(s, api.Options(minimum=60)).collect()
    assert [(r.spec_id, r.exports, r.documented, r.issues, r.health, r.passes) for r in scan] == [("s", 2, 1, 1, 25, False)]
    assert [r.name for r in api.listing(s, undocumented=True).orderBy("name").collect()] == ["beta", "gamma"]
    assert [r.name for r in api.listing(s, with_findings=True).collect()] == ["beta"] and api.get(s, "k0").count() == 1
    assert [r.name for r in api.suggestions(s, "alpa").collect()] == ["alpha"]
    assert tuple(api.filtered(s, kind="class")[1].first()) == (1, 3) and api.lint(s, api.Options(lint=False)).count() == 0
    rows = api.ci(s, spark.createDataFrame([("s",), ("t",)], "spec_id string").withColumn("dir", F.col("spec_id")), spark.createDataFrame([("s/x.ts",)], "path string"), 40).collect()
    assert [(r.spec_id, r.score, r.passes) for r in rows] == [("s", 50, True)]
    out = json.loads(render.envelope(api.coverage(s), "coverage", "1").first().value)
    assert out["ok"] and out["data"][0]["score"] == 50 and out["meta"]["command"] == "coverage"
    assert "- beta" in api.context(s).first().value and len(api.capabilities()) == len(api.COMMANDS)
    assert api.release(s, 90).first().ready is False


def test_result_checks(spark):
    good = spark.createDataFrame([("s", "a", "k", 50, ["params"], 0, 1)], "spec_id string, name string, export_key string, score int, missing array<string>, issues int, overloads int")
    assert validation.check_analysis(good).count() == 0
    bad = validation.check_analysis(good.withColumns({"score": F.lit(101), "missing": F.array(F.lit("odd"))})).first()
    assert bad.errors == ["score is out of range", "unknown rule"]
    assert scoring.spec_totals(good).first().score == 50


def test_lists_and_pages(spark):
    packages = spark.createDataFrame([(f"p{k:02d}", k == 3) for k in range(14)], "name string, private boolean")
    text = render.package_list(packages).first().value
    assert text.startswith("- p00\n- p01\n- p02\n- p04") and text.endswith("… and 3 more")
    at = lambda n: [r.name for r in predicates.page(packages, n, 5, "name").collect()]
    assert at(2) == ["p05", "p06", "p07", "p08", "p09"] and at(99) == at(3) and at(0)[0] == "p00"
    assert predicates.page(packages.limit(0), 1, 5, "name").collect() == []


def test_workspaces():
    assert files.workspace_globs({"workspaces": {"packages": ["a/*"]}}) == ["a/*", "packages/*"]
    assert files.workspace_globs({}, "packages:\n  - 'apps/*' # x\n  - packages/*\ncatalog:\n  - no\n") == ["apps/*", "packages/*"]
    assert files.workspace_globs(None, None, {"packages": ["l/*"]}) == ["l/*", "packages/*"]


def test_changelog_and_docs_map(spark, tmp_path):
    text = "# Log\n## 1.1.0\n### Minor\n- abc1234: Adds x\n- Updated dependencies\n## 1.0.0\n- First\n"
    got = markdown.changelog_entries(spark.createDataFrame([("c.md", text)], "path string, content string")).orderBy("pos").collect()
    assert [(r.version, r.section, r.item) for r in got] == [("1.1.0", "Minor", "Adds x"), ("1.0.0", None, "First")]
    files.write_docs_map(spark.createDataFrame([("b", "T", 1), ("a", "U", 0)], "page string, type string, baseline int"), str(tmp_path / "map"))
    back = files.docs_map(spark, str(tmp_path / "map")).orderBy("page_pos").collect()
    assert [(r.page, r.type, r.baselineGaps, r.errors) for r in back] == [("a", "U", 0, []), ("b", "T", 1, [])]
