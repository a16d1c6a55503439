"""Histories, reports, partial results, specs, docs maps and configuration as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = "date string, package string, coverage int, lint int, exports int, commit string"
SNAPSHOT = "timestamp timestamp, package string, version string, coverageScore int, totalExports int, documentedExports int, issueCount int, commit string, branch string"
MAP_PAGE = "page string, type string, section string, internal array<string>, deprecated array<string>, replacements map<string,string>, annotations map<string,string>, baselineGaps int"
ANNOTATIONS = ("internal", "deprecated", "ignore")


def history_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed lines are dropped. ``seq`` follows the order within a file, so of one date in a log that is partitioned by date."""
    rows = spark.read.schema(HISTORY + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL AND date IS NOT NULL").withColumn("seq", F.monotonically_increasing_id()).drop("_bad")


def append_history(rows: DataFrame, path: str) -> None:
    """Append to a log that is partitioned by date, so that range scans prune."""
    rows.write.mode("append").partitionBy("date").json(path)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file for each snapshot, newest name first; bad files are skipped."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", "true").option("mode", "PERMISSIVE").json(folder)
    return rows.withColumn("file", F.col("_metadata.file_name")).where("timestamp IS NOT NULL").orderBy(F.col("file").desc())


def recent(snapshots_: DataFrame, now: str, days: int) -> DataFrame:
    return snapshots_.where(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored report; no rows where it is malformed."""
    return spark.read.schema(schema + ", _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def partial_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Result rows of an interrupted run, and one row: expected, found, interrupted."""
    rows = spark.read.schema("type string, total int, id string, score int, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL")
    results = rows.where("type = 'result'").select("id", "score")
    state = rows.agg(F.max(F.when(F.col("type") == "header", F.col("total"))).alias("expected"), F.count_if(F.col("type") == "result").alias("found"))
    return results, state.withColumn("interrupted", F.coalesce(F.col("found") < F.col("expected"), F.lit(True)))


def specs(spark: SparkSession, path: str) -> DataFrame:
    """Spec files as exploded exports: spec_id, export_pos, export_key (id, else name), name, kind, description, deprecated, tag_names."""
    exports = T.ArrayType(T.StructType.fromDDL("id string, name string, kind string, description string, deprecated boolean, tags array<struct<name:string,text:string>>, source struct<file:string,line:int,package:string>"))
    schema = T.StructType([T.StructField("meta", T.StructType.fromDDL("name string, version string")), T.StructField("exports", exports)])
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("meta.name").alias("spec_id"), F.posexplode("exports").alias("export_pos", "e"))
    return rows.select("spec_id", "export_pos", F.coalesce(F.nullif("e.id", F.lit("")), "e.name").alias("export_key"), "e.name", "e.kind", "e.description", "e.deprecated", F.transform("e.tags", lambda t: t["name"]).alias("tag_names"), F.col("e.source.file").alias("source_file"), F.col("e.source.package").alias("source_package"), F.col("e.source.line").alias("source_line"))


def docs_map(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a docs map with ``errors``, what is wrong with each; a map of another version has one row that says so."""
    schema = f"version int, pages array<struct<{', '.join(f'{p.split()[0]}:{p.split(None, 1)[1]}' for p in _fields(MAP_PAGE))}>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    rows = raw.select("version", F.posexplode_outer("pages").alias("page_pos", "p")).select("version", "page_pos", "p.*")
    bad = [
        F.when(~F.col("version").eqNullSafe(1), F.concat(F.lit("version must be 1, not "), F.coalesce(F.col("version").cast("string"), F.lit("missing")))),
        F.when(F.coalesce(F.length("page"), F.lit(0)) == 0, "page is missing"),
        F.when(F.coalesce(F.length("type"), F.lit(0)) == 0, "type is missing"),
        F.when(F.coalesce("baselineGaps", F.lit(0)) < 0, "baselineGaps is negative"),
        F.when(F.exists(F.map_values(F.coalesce("annotations", F.create_map().cast("map<string,string>"))), lambda v: ~v.isin(*ANNOTATIONS)), "unknown annotation"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*bad)))


def _fields(ddl: str) -> list[str]:
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Package manifests below a folder: dir, name, version, private, workspaces, entry fields."""
    schema = "name string, version string, private boolean, main string, module string, types string, typings string, packageManager string, workspaces string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").json(root)
    return rows.withColumn("dir", F.regexp_replace(F.col("_metadata.file_path"), "/package.json$", "")).where("NOT dir RLIKE 'node_modules'")


def public_packages(manifests_: DataFrame) -> DataFrame:
    """Packages that aren't private, by name in collation order."""
    return manifests_.where(~F.coalesce("private", F.lit(False)) & F.col("name").isNotNull()).orderBy(F.collate("name", "UNICODE"))


def entry_candidate(fields: dict[str, Column]) -> Column:
    """First declared entry, mapped from the build folder to its source."""
    first = F.coalesce(*fields.values())
    return F.regexp_replace(F.regexp_replace(first, r"^(\./)?(dist|build|lib|out)/", "src/"), r"(\.d)?\.[cm]?[jt]s$", ".ts")


def package_manager(files: Column) -> Column:
    """By lock file, in the order of preference; ``files`` is an array of names."""
    out = None
    for name, locks in {"pnpm": ["pnpm-lock.yaml"], "bun": ["bun.lockb", "bun.lock"], "yarn": ["yarn.lock"], "npm": ["package-lock.json"]}.items():
        hit = F.arrays_overlap(files, F.array(*[F.lit(x) for x in locks]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("npm")


def build_kind(manifests_: DataFrame) -> DataFrame:
    """Whether a package builds, and for which target, by scripts and dependencies."""
    deps = F.map_keys(F.map_concat(F.coalesce("dependencies", F.create_map().cast("map<string,string>")), F.coalesce("devDependencies", F.create_map().cast("map<string,string>"))))
    build = F.coalesce(F.try_element_at("scripts", F.lit("build")), F.try_element_at("scripts", F.lit("compile")))
    target = F.when(F.exists(deps, lambda d: d.rlike("^(wasm-pack|.*assemblyscript.*)$")), "wasm").when(F.exists(deps, lambda d: d.rlike("napi")), "napi").otherwise("js")
    return manifests_.select("dir", "name", build.alias("build_script"), build.isNotNull().alias("builds"), target.alias("target"))


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*.{ts,tsx}") -> DataFrame:
    """(path, hash, modified): content hashes of a source tree, the key of cached results."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.substring(F.sha2("value", 256), 1, 16).alias("hash"), F.col("_metadata.file_modification_time").alias("modified")).where(r"NOT path RLIKE '/(\\.[^/]+|node_modules|dist)/'")


def source_kind(lang: Column, spec: Column, abi: Column, entry: Column) -> Column:
    """The kind of a source by its options: an explicit language, a document, an interface, else TypeScript."""
    known = lang.isin("typescript", "clarity", "openapi")
    return F.when(lang.isNotNull() & ~known, F.raise_error(F.concat(F.lit("unknown language "), lang))).when(known, lang).when(spec.isNotNull(), "openapi").when(abi.isNotNull() | F.coalesce(entry.endswith(".clar"), F.lit(False)), "clarity").otherwise("typescript")


def workspace_globs(manifest: dict | None, pnpm_yaml: str | None = None, lerna: dict | None = None) -> list[str]:
    """Folders of a workspace: from the manifest, else the pnpm file, else lerna; ``packages/*`` always counts."""
    globs: list[str] = []
    own = (manifest or {}).get("workspaces")
    if own:
        globs = list(own.get("packages", []) if isinstance(own, dict) else own)
    elif pnpm_yaml:
        inside = False
        for line in pnpm_yaml.splitlines():
            text = line.split("#", 1)[0].rstrip()
            if not text.strip():
                continue
            if not text[0].isspace() and not text.startswith("-"):
                inside = text.strip() == "packages:"
            elif inside and text.strip().startswith("-"):
                globs.append(text.strip()[1:].strip().strip("'\""))
    elif lerna:
        globs = list(lerna.get("packages", []))
    return [*dict.fromkeys([*globs, "packages/*"])]


def prune(spark: SparkSession, folder: str, keep: int = 100) -> int:
    """Delete all snapshot files but the ``keep`` with the newest names; returns how many went."""
    tree = Folder(spark, folder)
    gone = [n for n in tree.names() if n.endswith(".json")][::-1][keep:]
    for name in gone:
        tree.delete(name)
    return len(gone)


def save_report(df: DataFrame, path: str) -> None:
    """A report as one JSON document a row, and file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


_BUILD = ("dist", "build", "lib", "out", "output", "esm", "cjs", "target")
_FALLBACKS = ("src/index.ts", "src/index.tsx", "src/main.ts", "src/mod.ts", "src/lib/index.ts", "index.ts", "main.ts", "lib/index.ts", "source/index.ts")


def _sources_of(declared: Column, out_dir: Column, root_dir: Column) -> Column:
    """Where the source of a built file may lie, in order: by the compiler's folders, by usual ones, beside it."""
    plain = F.regexp_replace(declared, r"^\./", "")
    ends = ((r"\.js$", ".ts"), (r"\.d\.ts$", ".ts"), (r"\.mjs$", ".mts"), (r"\.cjs$", ".cts"), (r"\.js$", ".tsx"))
    as_source = lambda p: F.array(*[F.regexp_replace(p, a, b) for a, b in ends])
    none = F.array().cast("array<string>")
    o, r = (F.regexp_replace(x, r"^\./|/$", "") for x in (out_dir, root_dir))
    mapped = F.when(out_dir.isNotNull() & root_dir.isNotNull() & plain.startswith(F.concat(o, F.lit("/"))), as_source(F.concat(r, F.substring(plain, F.length(o) + 1, F.length(plain))))).otherwise(none)
    usual = F.when(plain.rlike(f"^(?:{'|'.join(_BUILD)})/"), as_source(F.regexp_replace(plain, r"^[^/]+/", "src/"))).otherwise(none)
    typed = F.when(plain.endswith(".d.ts"), F.array(F.concat(F.lit("src/"), F.regexp_extract(plain, r"([^/]+)\.d\.ts$", 1), F.lit(".ts")))).otherwise(none)
    own = F.when(plain.rlike(r"(?<!\.d)\.tsx?$"), F.array(plain)).otherwise(none)
    return F.concat(own, mapped, usual, as_source(plain), typed)


def entry_point(fields: dict[str, Column], there: Column, out_dir: Column | None = None, root_dir: Column | None = None) -> Column:
    """Struct (path, source, declaration_only): the source behind the first declared entry that there is.

    ``fields``: declared files by the field that names them, in order; ``there``: the package's
    files. Only where no source is found, the declaration file itself counts; then usual places.
    """
    out_dir, root_dir = (F.lit(None).cast("string") if x is None else x for x in (out_dir, root_dir))
    steps = []
    for source, declared in fields.items():
        plain = F.regexp_replace(declared, r"^\./", "")
        found = F.try_element_at(F.filter(_sources_of(declared, out_dir, root_dir), lambda p: F.array_contains(there, p) & ~p.endswith(".d.ts")), F.lit(1))
        typed = F.when(plain.endswith(".d.ts") & F.array_contains(there, plain), plain)
        path = F.coalesce(found, typed)
        steps.append(F.when(path.isNotNull(), F.struct(path.alias("path"), F.lit(source).alias("source"), found.isNull().alias("declaration_only"))))
    usual = F.try_element_at(F.filter(F.array(*[F.lit(f) for f in _FALLBACKS]), lambda p: F.array_contains(there, p)), F.lit(1))
    return F.coalesce(*steps, F.when(usual.isNotNull(), F.struct(usual.alias("path"), F.lit("fallback").alias("source"), F.lit(False).alias("declaration_only"))))


class Folder:
    """A file tree behind any file system that Spark reaches: what is there, what a file holds, what a folder lists."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root, self._spark = root.rstrip("/"), spark
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self._root}/{name}" if name else self._root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._at(name)).isDirectory()

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, in order; none where it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.is_folder(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), False)

    def text(self, name: str) -> str | None:
        """What a file holds; nothing where it isn't there."""
        if not self.exists(name) or self.is_folder(name):
            return None
        return self._spark.read.text(f"{self._root}/{name}", wholetext=True).first()[0]


def write_docs_map(pages: DataFrame, path: str) -> None:
    """A docs map (page, type, baseline) as one JSON document, pages in order: a scaffold, or lowered baselines."""
    rows = pages.select("page", "type", F.col("baseline").cast("int").alias("baselineGaps"))
    rows.agg(F.array_sort(F.collect_list(F.struct("page", "type", "baselineGaps"))).alias("pages")).select(F.lit(1).alias("version"), "pages").coalesce(1).write.mode("overwrite").json(path)
