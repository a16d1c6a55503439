"""Queries of the catalogue over sources and sinks: what is written to the shared folder is read back by the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cache, storage
from .catalogue import _DOC, query, table
from .operators import history, predicates, versions
from .plans.surface import derive
from .sinks import render
from .sources import contracts, files, markdown, rest_documents
from .sources import versions as version_table
from .streaming import runs


def _folder(spark: SparkSession, label: str) -> str:
    return f"{storage.shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _text(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)


# -- logs and snapshots


@query("history_log", "SELECT CAST(date AS VARCHAR) AS date, package, coverage, lint FROM history WHERE seq % 10 <> 0", "history")
def _(spark, sf):
    """A log of JSON lines with malformed ones between them."""
    path = _folder(spark, "log")
    h = derive(spark, sf, "history").withColumn("date", F.col("date").cast("string"))
    line = F.when(F.col("seq") % 20 == 0, F.lit("{broken")).when(F.col("seq") % 10 == 0, F.lit('{"date":null}')).otherwise(F.to_json(F.struct("date", "package", "coverage", "lint")))
    _text(h.select(line.alias("value")), path)
    return files.history_log(spark, path).select("date", "package", "coverage", "lint")


@query("history_appended", "SELECT date, package, coverage, lint FROM history UNION ALL SELECT date, package, 0, 1 FROM history WHERE seq % 50 = 0", "history")
def _(spark, sf):
    path = _folder(spark, "history")
    h = derive(spark, sf, "history").select("date", "package", "coverage", "lint")
    files.append_history(h, path)
    files.append_history(derive(spark, sf, "history").where("seq % 50 = 0").select("date", "package", F.lit(0).alias("coverage"), F.lit(1).alias("lint")), path)
    return spark.read.schema("package string, coverage int, lint int, date date").json(path).select("date", "package", "coverage", "lint")


@query("snapshot_range", "SELECT ts AS timestamp, event_type AS package, CAST(user_id AS INT) AS \"coverageScore\" FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 9 DAYS AND event_id % 9 <> 0")
def _(spark, sf):
    path = _folder(spark, "snapshots")
    e = table(spark, sf, "events")
    row = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_type").alias("package"), F.col("user_id").alias("coverageScore")))
    _text(e.select(F.when(F.col("event_id") % 9 == 0, F.lit("not a snapshot")).otherwise(row).alias("value")), path)
    rows = spark.read.schema(files.SNAPSHOT).json(path).where("timestamp IS NOT NULL")
    return files.recent(rows, "2024-01-30 00:00:00", 9).select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "package", "coverageScore")


@query("snapshot_files", "SELECT concat('s', n_nationkey, '.json') AS file, n_name AS package, CAST(n_regionkey AS INT) AS score, CAST(row_number() OVER (ORDER BY concat('s', n_nationkey, '.json') DESC) AS INT) AS age FROM nation")
def _(spark, sf):
    """One file a snapshot, newest name first."""
    path = _folder(spark, "snapshots")
    n = table(spark, sf, "nation")
    body = F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("timestamp"), F.col("n_name").alias("package"), F.col("n_regionkey").alias("coverageScore")))
    _single(n.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("name"), body.alias("value")), path)
    rows = files.snapshots(spark, path)
    w = Window.orderBy(F.col("file").desc())
    return rows.select("file", "package", F.col("coverageScore").alias("score"), F.row_number().over(w).alias("age"))


def _single(rows: DataFrame, path: str) -> None:
    """Files (name, value), each written by the task that has its row."""
    root = path

    def write(batches):
        import os

        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = (pafs.LocalFileSystem(), root.removeprefix("file:")) if "://" not in root else pafs.FileSystem.from_uri(root)
                place = f"{at}/{name}"
                fs.create_dir(os.path.dirname(place), recursive=True)
                with fs.open_output_stream(place) as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select("name", "value").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


@query("snapshot_row", f"SELECT count(*) AS exports, count(*) FILTER ({_DOC}) AS documented, (SELECT count(*) FROM exports WHERE deprecated <> tag_deprecated) AS issues, CAST(floor(100.0::DOUBLE * count(*) FILTER ({_DOC}) / count(*) + 0.5) AS INT) AS coverage FROM exports", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    return history.snapshot(e.withColumn("documented", predicates.documented()), e.where("deprecated <> tag_deprecated")).select("exports", "documented", "issues", "coverage")


@query("partial_results", "SELECT concat('e', event_id) AS id, CAST(user_id AS INT) AS score, (SELECT count(*) FROM events) AS expected, (SELECT count(*) FROM events WHERE event_id % 10 > 1) AS found, true AS interrupted FROM events WHERE event_id % 10 > 1")
def _(spark, sf):
    """The log of an interrupted run: a header, results, bad lines."""
    path = _folder(spark, "partial")
    e = table(spark, sf, "events")
    head = e.agg(F.count("*").alias("total")).select(F.to_json(F.struct(F.lit("header").alias("type"), "total")).alias("value"))
    line = F.when(F.col("event_id") % 10 == 0, F.lit('{"type":"result","id":')).otherwise(F.to_json(F.struct(F.lit("result").alias("type"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("user_id").alias("score"))))
    _text(head.unionByName(e.where("event_id % 10 <> 1").select(line.alias("value"))), path)
    results, state = files.partial_results(spark, path)
    s = state.first()
    return results.withColumns({"expected": F.lit(s.expected).cast("bigint"), "found": F.lit(s.found).cast("bigint"), "interrupted": F.lit(s.interrupted)})


@query("remaining_work", "SELECT export_key FROM exports WHERE size % 4 = 0", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    return runs.remaining(e.select("export_key"), e.where("size % 4 <> 0").unionByName(e.where("size % 4 = 1")), ["export_key"])


# -- specs, reports, versions


@query("spec_dump", "SELECT spec_id, export_key, name, kind, description, deprecated FROM exports", "exports")
def _(spark, sf):
    """A surface written as spec JSON and scanned again."""
    path = _folder(spark, "spec")
    e = derive(spark, sf, "exports").select("spec_id", F.col("export_pos").cast("int").alias("export_pos"), F.col("export_key").alias("id"), "name", "kind", "description", "deprecated")
    render.write_spec(e, path)
    return files.specs(spark, path).select("spec_id", "export_key", "name", "kind", "description", "deprecated")


@query("report_scan", "SELECT spec_id, CAST(count(*) AS INT) AS exports FROM exports GROUP BY spec_id HAVING max(export_pos) % 2 = 0", "exports")
def _(spark, sf):
    """Stored reports; malformed ones give no rows."""
    path = _folder(spark, "reports")
    r = derive(spark, sf, "exports").groupBy("spec_id").agg(F.count("*").alias("exports"), F.max("export_pos").alias("m"))
    _single(r.select(F.concat("spec_id", F.lit(".json")).alias("name"), F.when(F.col("m") % 2 == 0, F.to_json(F.struct("spec_id", "exports"))).otherwise(F.lit('{"spec_id": nothing')).alias("value")), path)
    return files.report(spark, path, "spec_id string, exports int")


@query("report_join", "SELECT e.spec_id, e.export_key, name, kind, CASE WHEN size % 3 = 0 THEN size END AS score, coalesce(CASE WHEN size % 3 = 0 THEN size % 4 END, 0) AS issues FROM (SELECT *, row_number() OVER (PARTITION BY export_key ORDER BY export_pos) AS n FROM exports) e WHERE size % 3 < 2 AND n = 1", "exports")
def _(spark, sf):
    e = derive(spark, sf, "exports")
    analysis = e.where("size % 3 < 2").select("export_key", F.when(F.col("size") % 3 == 0, F.col("size")).alias("score"), F.when(F.col("size") % 3 == 0, F.col("size") % 4).alias("issues"))
    return versions.report_join(analysis, e).select("spec_id", "export_key", "name", "kind", "score", "issues")


@query("time_travel", "SELECT export_key, name, 'old' AS side FROM exports WHERE size % 2 = 0 UNION ALL SELECT export_key, name, 'new' FROM exports WHERE size % 3 = 0", "exports")
def _(spark, sf):
    """Two refs of a version table; a ref that is saved again is replaced."""
    path = _folder(spark, "versions")
    e = derive(spark, sf, "exports").select("export_key", "name", "size")
    version_table.save_version(e, path, "v1")
    version_table.save_version(e.where("size % 3 = 0"), path, "v2")
    version_table.save_version(e.where("size % 2 = 0"), path, "v1")
    old, new = version_table.both_sides(spark, base="v1", head="v2", root=path)
    return old.select("export_key", "name", F.lit("old").alias("side")).unionByName(new.select("export_key", "name", F.lit("new").alias("side")))


@query("cached_table", "SELECT spec_id, count(*) AS exports, flag AS cached FROM exports, (SELECT unnest([false, true]) AS flag) GROUP BY spec_id, flag", "exports")
def _(spark, sf):
    """A result kept by content: built the first time, read the second."""
    root, e = _folder(spark, "kept"), derive(spark, sf, "exports")
    name = cache.key("1", cache.source_fingerprint(e.select(F.col("export_key").alias("path"), F.col("name").alias("hash"))), {"style": "minimal"})
    out = None
    for _ in range(2):
        rows, hit = cache.cached(spark, name, lambda: e.groupBy("spec_id").agg(F.count("*").alias("exports")), root)
        rows = rows.withColumn("cached", F.lit(hit))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("cache_validity", "SELECT export_key, CASE WHEN size % 2 = 1 THEN 'version' WHEN size % 3 = 1 THEN 'entry' WHEN size % 5 = 1 THEN 'config' WHEN size % 7 = 1 THEN 'compiler-config' WHEN size % 11 = 1 THEN 'manifest' WHEN size % 13 = 1 THEN 'sources' ELSE 'valid' END AS state FROM exports", "exports")
def _(spark, sf):
    ok = lambda k: F.col("size") % k != 1
    return derive(spark, sf, "exports").select("export_key", cache.validity(ok(2), ok(3), ok(5), ok(7), ok(11), ok(13)).alias("state"))


@query("cache_files", "SELECT count(*) AS entries, CAST(sum(length(s_name)) AS BIGINT) AS bytes FROM supplier")
def _(spark, sf):
    from . import api

    path = _folder(spark, "cache")
    _single(table(spark, sf, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"), F.col("s_name").alias("value")), path)
    return api.cache_status(spark.read.format("binaryFile").load(path)).select("entries", "bytes")


@query("source_hashes", "SELECT concat('s', s_suppkey, '.ts') AS file, substr(sha256(s_name), 1, 16) AS hash, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 < 2) AS newer FROM supplier WHERE s_suppkey % 3 = 0")
def _(spark, sf):
    """Content hashes of a source tree; other kinds of files and hidden folders are no sources."""
    path = _folder(spark, "sources")
    s = table(spark, sf, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 3 == 2, F.lit("node_modules/")).otherwise(F.lit("src/")), F.lit("s"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 1, F.lit(".txt")).otherwise(F.lit(".ts")))
    _single(s.select(name.alias("name"), F.col("s_name").alias("value")), path)
    hashes = files.file_hashes(spark, path)
    newest = cache.newest_change(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/src").select("path", F.col("modificationTime").alias("modified"))).first().modified
    newer = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/src").where(F.col("modificationTime") <= F.lit(newest)).count()
    return hashes.select(F.element_at(F.split("path", "/"), -1).alias("file"), "hash").withColumn("newer", F.lit(newer).cast("bigint"))


# -- docs maps, workspaces, Markdown


def _map_pages(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").alias("least"), F.count("*").alias("n"))
    return p.select("p_brand", "least", "n", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("k"))


@query("docs_map_scan", """WITH b AS (SELECT p_brand AS page, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS k FROM part GROUP BY 1)
SELECT CASE WHEN k % 5 = 0 THEN '' ELSE page END AS page, array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'page is missing' END, CASE WHEN k % 3 = 0 THEN 'type is missing' END, CASE WHEN k % 2 = 0 THEN 'baselineGaps is negative' END, CASE WHEN k % 7 = 0 THEN 'unknown annotation' END], lambda x: x IS NOT NULL), ';') AS errors FROM b""")
def _(spark, sf):
    path = _folder(spark, "map")
    p = _map_pages(spark, sf)
    page = F.struct(F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("page"), F.when(F.col("k") % 3 != 0, F.lit("Options")).alias("type"), F.when(F.col("k") % 2 == 0, -1).otherwise(1).alias("baselineGaps"), F.create_map(F.lit("a"), F.when(F.col("k") % 7 == 0, "other").otherwise("ignore")).alias("annotations"))
    p.agg(F.array_sort(F.collect_list(page.dropFields("annotations")), ).alias("__n"), F.collect_list(page).alias("pages")).select(F.lit(1).alias("version"), "pages").coalesce(1).write.json(path)
    return files.docs_map(spark, path).select("page", F.array_join("errors", ";").alias("errors"))


@query("docs_map_version", "SELECT 'version must be 1, not 2' AS errors")
def _(spark, sf):
    path = _folder(spark, "map")
    _single(spark.createDataFrame([("map.json", '{"version": 2, "pages": [{"page": "a.md", "type": "T"}]}')], "name string, value string"), path)
    return files.docs_map(spark, path).select(F.array_join("errors", ";").alias("errors"))


@query("docs_map_baselines", "WITH b AS (SELECT p_brand AS page, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS k FROM part GROUP BY 1) SELECT page, 'Options' AS type, CAST(CASE WHEN k % 3 = 0 THEN k WHEN k % 4 = 0 THEN 5 ELSE least(5, k) END AS INT) AS baseline FROM b")
def _(spark, sf):
    """Baselines are set where missing and lowered, never raised; the map is written and scanned again."""
    from .operators import keys

    path = _folder(spark, "map")
    p = _map_pages(spark, sf)
    old = p.where("k % 3 <> 0").select(F.col("p_brand").alias("page"), F.lit(5).cast("bigint").alias("baseline"))
    gate = p.where("k % 3 = 0 OR k % 4 <> 0").select(F.col("p_brand").alias("page"), F.col("k").cast("bigint").alias("gaps"))
    files.write_docs_map(keys.lowered_baselines(old, gate).withColumn("type", F.lit("Options")), path)
    return files.docs_map(spark, path).select("page", "type", F.col("baselineGaps").alias("baseline"))


@query("workspace_packages", """SELECT concat('pkg-', n_nationkey) AS name, CASE n_nationkey % 4 WHEN 0 THEN 'src/index.ts' WHEN 1 THEN 'src/main.ts' WHEN 2 THEN 'lib.ts' END AS entry, CASE n_nationkey % 5 WHEN 0 THEN 'pnpm' WHEN 1 THEN 'bun' WHEN 2 THEN 'yarn' ELSE 'npm' END AS manager,
n_nationkey % 2 = 0 AS builds, CASE WHEN n_nationkey % 6 = 0 THEN 'napi' WHEN n_nationkey % 6 = 1 THEN 'wasm' ELSE 'js' END AS target FROM nation WHERE n_nationkey % 7 <> 0""")
def _(spark, sf):
    """Package manifests of a workspace, without private ones."""
    path = _folder(spark, "workspace")
    n = table(spark, sf, "nation").withColumn("k", F.col("n_nationkey"))
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("k") % m + 1).cast("int"))
    body = F.to_json(F.struct(
        F.concat(F.lit("pkg-"), F.col("k").cast("string")).alias("name"), (F.col("k") % 7 == 0).alias("private"), F.when(F.col("k") % 4 == 0, "./dist/index.d.ts").alias("types"), F.when(F.col("k") % 4 < 2, "build/main.js").when(F.col("k") % 4 == 2, "lib.mjs").alias("main"),
        F.when(F.col("k") % 2 == 0, F.create_map(F.lit("build"), F.lit("tsc"))).alias("scripts"), F.when(F.col("k") % 6 == 0, F.create_map(F.lit("@napi-rs/cli"), F.lit("1"))).when(F.col("k") % 6 == 1, F.create_map(F.lit("wasm-pack"), F.lit("1"))).alias("devDependencies"),
    ))
    _single(n.select(F.concat(F.lit("packages/p"), F.col("k").cast("string"), F.lit("/package.json")).alias("name"), body.alias("value")), path)
    m = files.public_packages(files.manifests(spark, path))
    locks = F.when(F.col("k") % 5 == 0, F.array(F.lit("yarn.lock"), F.lit("pnpm-lock.yaml"))).when(F.col("k") % 5 == 1, F.array(F.lit("bun.lock"))).when(F.col("k") % 5 == 2, F.array(F.lit("yarn.lock"), F.lit("package-lock.json"))).otherwise(F.array(F.lit("README.md")))
    del pick
    out = m.withColumn("k", F.regexp_extract("name", "([0-9]+)", 1).cast("int")).select("dir", "name", files.entry_candidate({"types": F.col("types"), "main": F.col("main")}).alias("entry"), files.package_manager(locks).alias("manager"))
    return out.join(files.build_kind(m).select("dir", "builds", "target"), "dir").select("name", "entry", "manager", "builds", "target")


@query("source_kinds", "SELECT export_key, CASE WHEN size % 5 = 0 THEN 'openapi' WHEN size % 5 = 1 THEN 'clarity' WHEN size % 5 = 2 THEN 'clarity' WHEN size % 5 = 3 THEN 'openapi' ELSE 'typescript' END AS kind FROM exports", "exports")
def _(spark, sf):
    on = lambda k, v: F.when(F.col("size") % 5 == k, v)
    return derive(spark, sf, "exports").select("export_key", files.source_kind(on(0, "openapi"), on(3, "api.json"), on(1, "abi.json"), F.when(F.col("size") % 5 == 2, "a.clar").otherwise("a.ts")).alias("kind"))


@query("markdown_files", "SELECT CASE n_nationkey % 5 WHEN 0 THEN concat('docs/', n_name, '.md') WHEN 1 THEN concat('content/x/', n_name, '.mdx') ELSE concat(n_name, '/README.md') END AS path, concat('# ', n_name) AS content FROM nation WHERE n_nationkey % 5 <= 2")
def _(spark, sf):
    """Discovery by the default patterns: pages elsewhere, other kinds and build folders are left out."""
    path = _folder(spark, "pages")
    k = F.col("n_nationkey") % 5
    name = F.when(k == 0, F.concat(F.lit("docs/"), "n_name", F.lit(".md"))).when(k == 1, F.concat(F.lit("content/x/"), "n_name", F.lit(".mdx"))).when(k == 2, F.concat("n_name", F.lit("/README.md"))).when(k == 3, F.concat(F.lit("docs/node_modules/"), "n_name", F.lit(".md"))).otherwise(F.concat(F.lit("other/"), "n_name", F.lit(".md")))
    _single(table(spark, sf, "nation").select(name.alias("name"), F.concat(F.lit("# "), "n_name").alias("value")), path)
    return markdown.discover(spark, path)


@query("markdown_corpus", "SELECT concat('other/', n_name, '.md') AS path FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, sf):
    """A corpus by the caller's pattern."""
    path = _folder(spark, "pages")
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("other/")).otherwise(F.lit("docs/")), "n_name", F.lit(".md"))
    _single(table(spark, sf, "nation").select(name.alias("name"), F.lit("x").alias("value")), path)
    return markdown.discover(spark, path, include="^other/").select("path")


@query("markdown_headings", """SELECT concat('d', doc_id) AS path, unnest([1, 6]) AS line, unnest([2, 3]) AS level, unnest([source, concat('End of ', lang)]) AS title FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    content = F.concat(F.lit("## "), "source", F.lit(" ##\n```\n# fenced\n```\ntext\n### End of "), "lang", F.lit("\n#no heading"))
    return markdown.headings(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))).select("path", "line", "level", "title")


@query("changelog_entries", """SELECT concat('p', p_partkey) AS path, unnest([concat('1.', p_size), concat('1.', p_size), '0.9']) AS version, unnest(['Minor', 'Minor', NULL]) AS section, unnest([p_name, 'second', 'old']) AS item FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    content = F.concat(F.lit("# Log\n- before\n## 1."), F.col("p_size").cast("string"), F.lit("\n### Minor\n- abc1234: "), "p_name", F.lit("\n- Updated dependencies\n* second\n## 0.9\n- old"))
    return markdown.changelog_entries(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content"))).select("path", "version", "section", "item")


@query("prose_mentions", "SELECT DISTINCT concat('p', p_partkey) AS path, unnest(['key', split_part(p_name, ' ', 1)]) AS key FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    content = F.concat(F.lit("The `key.sub` and `"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("` of `2`\n```\n`fenced`\n```"))
    return markdown.mentions(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content")))


@query("folder_tree", "SELECT concat('n', n_nationkey, '.txt') AS name, n_name AS text, false AS folder FROM nation UNION ALL SELECT 'inner', NULL, true UNION ALL SELECT 'missing', NULL, false")
def _(spark, sf):
    """A file tree by its interface: names, contents, kinds; what isn't there has no text and is no folder."""
    path = _folder(spark, "tree")
    n = table(spark, sf, "nation")
    _single(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.col("n_name").alias("value")).unionByName(spark.createDataFrame([("inner/x", "y")], "name string, value string")), path)
    tree = files.Folder(spark, path)
    return spark.createDataFrame([(name, tree.text(name), tree.is_folder(name)) for name in [*tree.names(), "missing"]], "name string, text string, folder boolean")


@query("workspace_folders", "SELECT unnest(['apps/*', 'packages/*', 'libs/a', 'packages/*', 'packages/*']) AS folder, unnest(['pnpm', 'pnpm', 'manifest', 'manifest', 'none']) AS source")
def _(spark, sf):
    """Workspace folders by manifest, by the other file, and by default."""
    pnpm = "packages:\n  - 'apps/*' # all\n  - packages/*\nother:\n  - x\n"
    found = [(g, "pnpm") for g in files.workspace_globs({}, pnpm)] + [(g, "manifest") for g in files.workspace_globs({"workspaces": ["libs/a"]}, pnpm)] + [(g, "none") for g in files.workspace_globs(None)]
    return spark.createDataFrame(found, "folder string, source string")


# -- REST documents and contracts


def _rest(spark, sf, op, components: str = "{}") -> DataFrame:
    p = table(spark, sf, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return rest_documents.parse(p.select(F.concat(F.lit("d"), "id").alias("doc"), F.concat(F.lit('{"openapi":"'), F.when(F.col("p_size") % 10 == 0, "2.0").otherwise("3.1.0"), F.lit('","paths":{"/p":{"get":'), op, F.lit('}},"components":'), F.lit(components), F.lit("}")).alias("content")))


@query("rest_responses", "SELECT concat('d', p_partkey) AS doc, CASE p_size % 4 WHEN 0 THEN '200' WHEN 1 THEN 'default' WHEN 2 THEN '201' END AS code, CASE p_size % 4 WHEN 0 THEN '{\"type\":\"string\"}' WHEN 1 THEN '{\"type\":\"number\"}' ELSE '\"void\"' END AS schema_json FROM part WHERE p_size % 10 <> 0")
def _(spark, sf):
    """The lowest success code, else the default; exactly JSON, else what mentions it."""
    k = F.col("p_size") % 4
    body = F.when(k == 0, '{"404":{},"204":{},"200":{"content":{"text/x":{"schema":{"type":"no"}},"application/json":{"schema":{"type":"string"}}}}}').when(k == 1, '{"500":{},"default":{"content":{"a/b":{"schema":{"type":"no"}},"x/vnd+json":{"schema":{"type":"number"}}}}}').when(k == 2, '{"201":{"description":"x"}}').otherwise('{"404":{}}')
    ops = rest_documents.operations(_rest(spark, sf, F.concat(F.lit('{"responses":'), body, F.lit("}"))))
    return rest_documents.responses(ops).select("doc", "code", "schema_json")


@query("rest_bodies", "SELECT concat('d', p_partkey) AS doc, unnest(CASE WHEN p_size % 2 = 0 THEN ['a', 'b'] ELSE ['body'] END) AS name, unnest(CASE WHEN p_size % 2 = 0 THEN [false, true] ELSE [true] END) AS required FROM part WHERE p_size % 10 <> 0")
def _(spark, sf):
    schema = F.when(F.col("p_size") % 2 == 0, '{"type":"object","required":["b"],"properties":{"a":{"type":"x"},"b":{"type":"y"}}}').otherwise('{"type":"string"}')
    ops = rest_documents.operations(_rest(spark, sf, F.concat(F.lit('{"requestBody":{"required":true,"content":{"application/json":{"schema":'), schema, F.lit("}}}}"))))
    return rest_documents.body_parameters(ops).select("doc", "name", "required")


_COMPONENTS = '{"schemas":{"A":{"type":"object","properties":{"b":{"$ref":"#/components/schemas/B"},"self":{"$ref":"#/components/schemas/A"}}},"B":{"type":"string"}}}'


@query("rest_types", """SELECT concat('d', p_partkey) AS doc, unnest(['A', 'B']) AS name, unnest(['{"type":"string","title":"B"}', NULL]) AS b, unnest(['{"$ref":"#/components/schemas/A"}', NULL]) AS self FROM part WHERE p_size % 10 <> 0""")
def _(spark, sf):
    """Component schemas with their references inlined; a reference to itself stays."""
    t = rest_documents.types(_rest(spark, sf, F.lit("{}"), _COMPONENTS))
    b = F.get_json_object("schema_json", "$.properties.b")
    ordered = F.when(b.isNotNull(), F.to_json(F.struct(F.get_json_object(b, "$.type").alias("type"), F.get_json_object(b, "$.title").alias("title"))))
    return t.select("doc", "name", ordered.alias("b"), F.get_json_object("schema_json", "$.properties.self").alias("self"))


@query("rest_pointers", """SELECT concat('d', p_partkey) AS doc, unnest(['#/components/schemas/B', '#/components/schemas/C', 'other.json#/x']) AS ref, unnest(['{"type":"string"}', NULL, NULL]) AS node_json FROM part WHERE p_size % 10 <> 0""")
def _(spark, sf):
    parsed = _rest(spark, sf, F.lit("{}"), _COMPONENTS)
    refs = parsed.where("valid").select("doc", F.explode(F.array(*[F.lit(r) for r in ("#/components/schemas/B", "#/components/schemas/C", "other.json#/x")])).alias("ref"))
    return rest_documents.resolve(refs, rest_documents.pointers(parsed)).select("doc", "ref", "node_json")


_ARGS = ['"uint128"', '{"buffer":{"length":32}}', '{"string-ascii":{"length":8}}', '{"list":{"type":"bool","length":4}}', '{"optional":"principal"}', '{"response":{"ok":"uint128","error":"none"}}', '{"tuple":[{"name":"x","type":"int128"}]}']
_ARG_SCHEMAS = ['"uint"', '{"type": "buffer", "maxLength": 32}', '{"type": "string", "encoding": "ascii", "maxLength": 8}', '{"type": "array", "items": "boolean", "maxItems": 4}', '{"anyOf": ["principal", {"type": "null"}]}', '{"type": "response", "ok": "uint", "error": "null"}', '{"type": "object", "properties": {"x": "int"}, "required": ["x"]}']


@query("contract_params", "SELECT concat('c', s_suppkey) AS contract, concat('f', s_nationkey) AS function, 'arg' AS name, true AS required, list_extract([" + ", ".join(f"'{s}'" for s in _ARG_SCHEMAS) + "], CAST(s_suppkey % 7 + 1 AS INT)) AS schema_json FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    arg = F.element_at(F.array(*[F.lit(a) for a in _ARGS]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    abi = F.concat(F.lit('{"functions":[{"name":"f'), F.col("s_nationkey").cast("string"), F.lit('","access":"public","args":[{"name":"arg","type":'), arg, F.lit("}]}]}"))
    return contracts.params(s.select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("contract"), abi.alias("abi"))).select("contract", "function", "name", "required", "schema_json")
