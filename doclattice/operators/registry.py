"""Dimensions that detectors probe: known names, members and their owners, modules, reachable types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import found
from ..storage import materialize


def names(exports: DataFrame, types: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Distinct names that a link or example may use: export names and ids, types, namespace members."""
    out = exports.select("name").unionByName(exports.select(F.col("export_key").alias("name")))
    if types is not None:
        out = out.unionByName(types.select("name"))
    if members is not None:
        out = out.unionByName(members.select(F.concat_ws(".", "class", "member").alias("name")))
    return out.where("name IS NOT NULL").distinct()


def member_owners(members: DataFrame) -> DataFrame:
    """For each member name how many types declare it, in how many it is deprecated, and whether in all."""
    per = members.groupBy("member", "class").agg(F.bool_or(F.coalesce("deprecated", F.lit(False))).alias("d"))
    return per.groupBy("member").agg(F.count("*").alias("owners"), F.count_if("d").alias("deprecated_in")).withColumn("deprecated_everywhere", F.col("owners") == F.col("deprecated_in"))


def deprecated_exports(exports: DataFrame) -> DataFrame:
    """Deprecated by flag or tag, with a note: the reason, else the tag's text."""
    return exports.where(F.coalesce("deprecated", F.lit(False)) | F.coalesce("tag_deprecated", F.lit(False))).select("name", F.coalesce("reason", "tag_text", F.lit("")).alias("note"))


def return_owner(exports: DataFrame) -> DataFrame:
    """What calling a name gives: a class gives itself, a function the type that its return names, out of a promise."""
    ref = F.coalesce(found("return_type", r"(?i)^promise<\s*([\w.$]+)"), F.when(~F.lower("return_type").startswith("promise"), F.regexp_extract("return_type", r"([\w$]+)\s*$", 1)))
    return exports.where("kind IN ('function', 'class')").select("name", F.when(F.col("kind") == "class", F.col("name")).otherwise(F.nullif(ref, F.lit(""))).alias("gives"))


def module_graph(exports: DataFrame) -> DataFrame:
    """For each name the first module that has it (by module order) and the number of modules."""
    return exports.groupBy("name").agg(F.min_by("spec_id", F.struct("module_pos", "export_pos")).alias("module"), F.count_distinct("spec_id").alias("modules"))


def find_entry(wanted: DataFrame, exports: DataFrame, types: DataFrame) -> DataFrame:
    """The entry that each wanted name (name) stands for: an export, else a type, else nothing; the first of equal names."""
    both = exports.select("name", "export_key", "export_pos", F.lit(0).alias("rank")).unionByName(types.select("name", "export_key", "export_pos", F.lit(1).alias("rank")))
    first = both.groupBy("name").agg(F.min(F.struct("rank", "export_pos", "export_key")).alias("e"))
    return wanted.select("name").distinct().join(first, "name", "left").select("name", F.col("e.export_key").alias("export_key"), F.when(F.col("e.rank") == 0, "export").when(F.col("e.rank") == 1, "type").alias("place"))


def find_module(wanted: DataFrame, exports: DataFrame, types: DataFrame) -> DataFrame:
    """The module of each wanted name; exports come before types."""
    first = lambda df: df.groupBy("name").agg(F.min_by("spec_id", "module_pos").alias("module"))
    e, t = first(exports), first(types).withColumnRenamed("module", "type_module")
    return wanted.select("name").distinct().join(e, "name", "left").join(t, "name", "left").select("name", F.coalesce("module", "type_module").alias("module"))


def reachable(edges: DataFrame, roots: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Nodes that the roots reach over edges (src, dst), with their distance; blocked nodes end a way.

    A loop over frontiers: each step joins only the nodes that are new, and each result is a
    table, so plans don't grow and cycles end by themselves.
    """
    if blocked is not None:  # once, on the edges, in place of once a step
        edges = edges.join(blocked.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")
        roots = roots.join(blocked.select("node"), "node", "left_anti")
    edges = materialize(edges.select("src", "dst").distinct(), "edges")

    def level(nodes: DataFrame, depth: int) -> tuple[DataFrame, int]:
        seen_by = Observation()
        table = materialize(nodes.withColumn("depth", F.lit(depth)).observe(seen_by, F.count(F.lit(1)).alias("n")), "frontier")
        return table, seen_by.get["n"]

    front, n = level(roots.select("node").distinct(), 0)
    seen, depth = front, 0
    while n:
        depth += 1
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front, n = level(step.join(seen.select("node"), "node", "left_anti"), depth)
        if n:
            seen = seen.unionByName(front)
    return seen
