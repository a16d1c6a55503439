"""Code in prose against the registry: imports, members and deprecated names.

The input is the fact table of ``sources.code_facts``. Context grows from block to block of a
file, so a fact counts for all blocks at or after its own: a join on path and name with an
inequality on the block, aggregated to the first block that establishes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predicates import last_wins


def _from_package(package: str):
    return (F.col("module") == package) | F.col("module").startswith(package + "/")


def broken_imports(facts: DataFrame, names: DataFrame, package: str) -> DataFrame:
    """Named imports from the package that it doesn't export."""
    imports = facts.where((F.col("fact") == "import") & F.col("kind").endswith("named") & _from_package(package))
    return imports.join(names.select("name").distinct(), "name", "left_anti").select("path", "block", "line", F.lit("prose-import").alias("type"), F.col("name").alias("target"))


def first_block(facts: DataFrame, *keys: str) -> DataFrame:
    """The first block of each file from which a name is known."""
    return facts.groupBy("path", *keys).agg(F.min("block").alias("since"))


def derived_names(facts: DataFrame, known: DataFrame, package: str, builders: DataFrame) -> DataFrame:
    """Names that hold what the package's callables give: path, name, gives, block; the last assignment up to a block counts.

    ``known``: path, object (local names of the package's imports); ``builders``: name, gives.
    """
    made = facts.where("fact = 'derived'").select("path", "block", "pos", "name", F.col("object").alias("callee"))
    return made.join(builders.select(F.col("name").alias("callee"), "gives"), "callee").select("path", "block", "pos", "name", "gives")


def unresolved_members(facts: DataFrame, package: str, names: DataFrame, members: DataFrame, builders: DataFrame, builtins: DataFrame) -> DataFrame:
    """Method calls that no known type has, once per object and method of a block.

    Left out are receivers that are exports, come from other packages (or hold what those
    give), are parameters or undetermined locals, and built-in methods of locals.
    """
    w = Window.partitionBy("path", "block", "object", "name").orderBy("pos")
    calls = facts.where("fact = 'method' AND object <> 'this'").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    calls = calls.withColumn("root", F.substring_index("object", ".", 1))
    calls = calls.join(names.select(F.col("name").alias("root")).distinct(), "root", "left_anti")
    imports = facts.where("fact = 'import'").select("path", "block", F.col("object").alias("root"), _from_package(package).alias("own"))
    outside = first_block(imports.where("NOT own"), "root")
    made = facts.where("fact = 'derived'").select("path", "block", F.col("name").alias("root"), "object")
    from_outside = first_block(made.join(imports.where("NOT own").select("path", F.col("root").alias("object"), F.col("block").alias("b")), ["path", "object"]).where("b <= block"), "root")
    params = first_block(facts.where("fact = 'param' AND kind IS NULL").select("path", "block", F.col("name").alias("root")), "root")
    for known in (outside, from_outside, params):
        calls = calls.join(known, ["path", "root"], "left").where("since IS NULL OR since > block").drop("since")
    gives = derived_names(facts, imports, package, builders).select("path", F.col("name").alias("root"), F.col("block").alias("b"), F.col("pos").alias("p"), "gives")
    latest = calls.join(gives, ["path", "root"], "left").where("b IS NULL OR b <= block").groupBy("path", "block", "pos", "line", "object", "root", "name").agg(F.max_by("gives", F.struct("b", "p")).alias("gives"))
    local = first_block(facts.where("fact IN ('local', 'derived')").select("path", "block", F.col("name").alias("root")), "root").withColumn("is_local", F.lit(True)).drop("since")
    latest = latest.join(local, ["path", "root"], "left").join(builtins.select(F.col("name"), F.lit(True).alias("builtin")), "name", "left")
    latest = latest.where("NOT (coalesce(is_local, false) AND coalesce(builtin, false))")
    latest = latest.where("NOT (coalesce(is_local, false) AND gives IS NULL)")  # nothing says that it is of the package
    known = latest.join(members.select(F.col("member").alias("name")).distinct(), "name", "left_anti")
    return known.select("path", "block", "line", F.lit("prose-member").alias("type"), F.concat_ws(".", "object", "name").alias("target"))


def deprecated_references(facts: DataFrame, package: str, deprecated: DataFrame, owners: DataFrame, builders: DataFrame, member_flags: DataFrame) -> DataFrame:
    """Imports of deprecated exports and calls of deprecated members, once per name and file.

    Where the receiver's type is known it decides; else a method must be deprecated on every
    type that has it. ``member_flags``: class, member, deprecated.
    """
    imports = facts.where(F.col("fact") == "import").where(_from_package(package)).join(deprecated.select("name", "note"), "name").select("path", "block", "pos", "line", "name", "note")
    calls = facts.where("fact = 'method'").select("path", "block", "pos", "line", "name", F.col("object").alias("root"))
    gives = facts.where("fact = 'derived'").join(builders.select(F.col("name").alias("object"), "gives"), "object").select("path", F.col("name").alias("root"), F.col("block").alias("b"), F.col("pos").alias("p"), "gives")
    typed = calls.join(gives, ["path", "root"], "left").where("b IS NULL OR b < block OR (b = block AND p <= pos)")
    typed = typed.groupBy("path", "block", "pos", "line", "name").agg(F.max_by("gives", F.struct("b", "p")).alias("gives"))
    flags = member_flags.groupBy(F.col("class").alias("gives"), F.col("member").alias("name")).agg(F.bool_or("deprecated").alias("on_type"))
    typed = typed.join(flags, ["gives", "name"], "left").join(owners.select(F.col("member").alias("name"), "deprecated_everywhere"), "name", "left")
    hit = typed.where(F.when(F.col("gives").isNotNull(), F.coalesce("on_type", F.lit(False))).otherwise(F.coalesce("deprecated_everywhere", F.lit(False)))).select("path", "block", "pos", "line", "name", F.lit("").alias("note"))
    both = imports.unionByName(hit)
    w = Window.partitionBy("path", "name").orderBy("block", "pos")
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("path", "block", "line", F.lit("prose-deprecated").alias("type"), F.col("name").alias("target"), "note")


def latest_members(changes: DataFrame) -> DataFrame:
    """The last change of each member name."""
    return last_wins(changes, ["member"], "class")
