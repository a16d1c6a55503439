"""Markdown corpora: files, fenced code blocks, documented keys, as window expressions over lines.

A file is split into lines once; whether a line is inside a fence is the parity of a running
count, so no parser runs per file and all of it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import key_token, trim
from ..operators.predicates import executable_language

EXCLUDED = r"(^|/)(node_modules|dist|build|\.git|\.next|coverage|CHANGELOG\.md)(/|$)"


def discover(spark: SparkSession, root: str, include: str = r"(^|/)(README\.mdx?|(docs|content)/.*\.mdx?)$", exclude: str = EXCLUDED) -> DataFrame:
    """(path, content) of the Markdown files below a folder; paths are relative, each once."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}").text(root, wholetext=True)
    base = root.rstrip("/") + "/"
    path = F.expr(f"substring(_metadata.file_path, instr(_metadata.file_path, '{base}') + {len(base)})")
    return files.select(path.alias("path"), F.col("value").alias("content")).where(F.col("path").rlike(include) & ~F.col("path").rlike(exclude)).dropDuplicates(["path"])


def doc_lines(files: DataFrame) -> DataFrame:
    """(path, line, text, fence, inside): lines from 1, fence marks, whether a line is in a fence."""
    rows = files.select("path", F.posexplode(F.split("content", r"\r?\n", -1)).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")
    mark = F.col("text").rlike(r"^\s*(```|~~~)")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fence", mark).withColumn("fences", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)))
    return rows.withColumn("inside", (F.col("fences") % 2 == 1) & ~F.col("fence"))


def code_blocks(files: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Fenced blocks in an executable language: path, block, lang, meta, code, first and last fence line."""
    rows = doc_lines(files)
    # an opening fence has an even number before it; its lines and its end have one more
    rows = rows.where("fence OR inside").withColumn("block", F.ceil(F.when(F.col("fence") & (F.col("fences") % 2 == 0), F.col("fences") + 1).otherwise(F.col("fences")) / 2).cast("int"))
    opening = F.col("fence") & (F.col("fences") % 2 == 0)
    out = rows.groupBy("path", "block").agg(
        F.max(F.when(opening, F.regexp_extract("text", r"^\s*(?:```+|~~~+)\s*([\w-]*)", 1))).alias("lang"),
        F.max(F.when(opening, trim(F.regexp_extract("text", r"^\s*(?:```+|~~~+)\s*[\w-]*\s*(.*)$", 1)))).alias("meta"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("line", "text")))), lambda s: s["text"]), "\n").alias("code"),
        F.min("line").alias("line_start"), F.max("line").alias("line_end"),
    )
    return out.where(executable_language("lang", languages) if languages else executable_language("lang"))


def headings(files: DataFrame) -> DataFrame:
    """Headings outside fences: path, line, level, title."""
    rows = doc_lines(files).where("NOT inside AND NOT fence")
    return rows.select("path", "line", F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)).alias("level"), trim(F.regexp_extract("text", r"^#{1,6}\s+(.*?)\s*#*$", 1)).alias("title")).where("level > 0")


def section_lines(files: DataFrame, pattern: Column | str) -> DataFrame:
    """Lines that lie in a section whose heading matches; a section ends at a heading of its level or above.

    The latest matching heading decides (a matching one below it moves its level), so a line
    is inside while no heading of that level or above came after it.
    """
    rows = doc_lines(files)
    level = F.when(~F.col("inside") & ~F.col("fence"), F.nullif(F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)), F.lit(0)))
    title = F.regexp_extract("text", r"^#{1,6}\s+(.*?)\s*#*$", 1)
    want = F.lit(pattern) if isinstance(pattern, str) else pattern
    rows = rows.withColumn("level", level).withColumn("hit", F.col("level").isNotNull() & F.regexp_like(title, want))
    up = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("opened", F.last(F.when(F.col("hit"), F.struct("line", "level")), ignorenulls=True).over(up))
    group = Window.partitionBy("path", "opened.line").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closed = F.max(F.when(~F.col("hit") & (F.col("level") <= F.col("opened.level")), 1).otherwise(0)).over(group)
    return rows.withColumn("closed", closed).where("opened IS NOT NULL AND closed = 0")


def documented_keys(files: DataFrame, pattern: Column | str) -> DataFrame:
    """(path, key, line): the first code word of the first cell of table rows in matching sections."""
    rows = section_lines(files, pattern).where(~F.col("inside") & ~F.col("fence") & F.col("text").rlike(r"^\s*\|") & ~F.col("text").rlike(r"^\s*\|[\s:|-]+$"))
    cell = F.regexp_extract("text", r"^\s*\|([^|]*)", 1)
    return rows.select("path", key_token(F.regexp_extract(cell, "`([^`]+)`", 1)).alias("key"), "line").where("key IS NOT NULL")


def mentions(files: DataFrame) -> DataFrame:
    """(path, key): code words outside fences."""
    rows = doc_lines(files).where("NOT inside AND NOT fence")
    return rows.select("path", F.explode(F.regexp_extract_all("text", F.lit("`([^`]+)`"), 1)).alias("w")).select("path", key_token("w").alias("key")).where("key IS NOT NULL").distinct()


def changelog_entries(files: DataFrame) -> DataFrame:
    """(path, pos, version, section, item): bullets of a changelog by ``##`` version and ``###`` section; commit references go."""
    rows = doc_lines(files)
    up = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = lambda marks: F.nullif(trim(F.regexp_extract("text", rf"^{marks}\s+(.+)$", 1)), F.lit(""))
    rows = rows.withColumn("v", heading("##")).withColumn("version", F.last("v", ignorenulls=True).over(up))
    here = Window.partitionBy("path", "version").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.last(heading("###"), ignorenulls=True).over(here))
    item = trim(F.regexp_replace(F.regexp_extract("text", r"^\s*[-*]\s+(.*)$", 1), r"^(?:\[?[0-9a-f]{7,40}\]?(?:\([^)]*\))?:?\s*)+", ""))
    return rows.withColumn("item", item).where("version IS NOT NULL AND NOT inside AND item <> '' AND item NOT RLIKE '^Updated dependencies'").select("path", F.col("line").alias("pos"), "version", "section", "item")
