"""REST documents (OpenAPI 3.x JSON) to surface tables, with VARIANT expressions.

``load`` reads whole files; everything after it is relational: paths and methods explode to
one export each, parameters merge by level, references resolve by a join with the
document's pointers. Only the inlining of nested references, a tree rewrite, is a function on
JSON text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import truthy

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc, content) of JSON documents."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("content"))


def parse(docs: DataFrame) -> DataFrame:
    """(doc, v, valid): the document as VARIANT and whether it is a REST document of version 3."""
    v = F.try_parse_json("content")
    return docs.select("doc", v.alias("v")).withColumn("valid", F.coalesce(F.try_variant_get("v", "$.openapi", "string").startswith("3."), F.lit(False)))


def _text(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _json(v: Column | str, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def _members(v: Column | str, path: str) -> Column:
    """Array of (key, value) of an object, or of an array without keys, each value a variant by itself.

    A value taken out of a variant keeps the names of the whole document with it, so the rows of
    a document would grow with the square of its size.
    """
    text = _json(v, path)
    of_array = F.transform(F.from_json(text, "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(F.map_entries(F.from_json(text, "map<string,variant>")), of_array)


def operations(parsed: DataFrame) -> DataFrame:
    """One row per operation: name, description, summary tag, path, method, place in the document.

    The name is the operation id, else ``METHOD path``; the description is the summary where
    there is none. Invalid documents have no operations.
    """
    parsed.where("valid").select("doc", F.posexplode(_members("v", "$.paths")).alias("path_pos", "p")).createOrReplaceTempView("__rest_paths")
    rows = parsed.sparkSession.sql("""
      SELECT doc, path_pos, p.key AS path, p.value AS item, o.key AS method, o.value AS op
      FROM __rest_paths, LATERAL variant_explode(p.value) o""")
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    rows = rows.where(F.col("method").isin(*METHODS))
    summary, text = _text("op", "$.summary"), _text("op", "$.description")
    return rows.select(
        "doc",
        F.row_number().over(Window.partitionBy("doc").orderBy("path_pos", rank)).alias("export_pos"),
        F.coalesce(_text("op", "$.operationId"), F.concat(F.upper("method"), F.lit(" "), F.col("path"))).alias("name"),
        F.lit("function").alias("kind"),
        F.coalesce(text, summary).alias("description"),
        F.when(truthy(text) & truthy(summary), summary).alias("summary_tag"),
        F.coalesce(F.try_variant_get("op", "$.deprecated", "boolean"), F.lit(False)).alias("deprecated"),
        "path", F.upper("method").alias("method"), _json("op", "$.tags").alias("tags"), "item", "op",
    )


def parameters(ops: DataFrame) -> DataFrame:
    """Parameters of operations: of the path, then of the operation, which wins by place and name but keeps the first position."""
    ops.select("doc", "export_pos", "item", "op").createOrReplaceTempView("__rest_operations")
    rows = ops.sparkSession.sql("""
      SELECT doc, export_pos, 0 AS level, p.pos, p.value AS v FROM __rest_operations, LATERAL variant_explode(variant_get(item, '$.parameters')) p
      UNION ALL SELECT doc, export_pos, 1, p.pos, p.value FROM __rest_operations, LATERAL variant_explode(variant_get(op, '$.parameters')) p""")
    rows = rows.select("doc", "export_pos", "level", "pos", _text("v", "$.in").alias("place"), _text("v", "$.name").alias("name"), F.coalesce(F.try_variant_get("v", "$.required", "boolean"), F.lit(False)).alias("required"), _text("v", "$.description").alias("description"), F.coalesce(_json("v", "$.schema"), F.lit('{"type":"unknown"}')).alias("schema_json")).where("name IS NOT NULL")
    merged = rows.groupBy("doc", "export_pos", "place", "name").agg(F.min(F.struct("level", "pos")).alias("first"), F.max_by(F.struct("required", "description", "schema_json"), F.struct("level", "pos")).alias("last"))
    own = merged.select("doc", "export_pos", "first.level", "first.pos", "place", "name", "last.*")
    body = body_parameters(ops)
    out = own.unionByName(body)
    return out.withColumn("param_pos", F.row_number().over(Window.partitionBy("doc", "export_pos").orderBy("level", "pos", "name"))).drop("level", "pos")


def _media(v: Column, path: str) -> Column:
    """Schema of a content map: exactly JSON, else the first type that mentions it, else the first."""
    names = F.map_keys(F.from_json(F.to_json(F.try_variant_get(v, path, "variant")), "map<string,string>"))
    jsonish = F.try_element_at(F.filter(names, lambda n: F.contains(n, F.lit("json"))), F.lit(1))
    pick = F.when(F.array_contains(names, "application/json"), F.lit("application/json")).otherwise(F.coalesce(jsonish, F.try_element_at(names, F.lit(1))))
    content = F.from_json(F.to_json(F.try_variant_get(v, path, "variant")), "map<string,string>")
    return F.get_json_object(F.try_element_at(content, pick), "$.schema")


def body_parameters(ops: DataFrame) -> DataFrame:
    """A JSON object body gives a parameter for each property, another body one named ``body``."""
    schema = _media(F.col("op"), "$.requestBody.content")
    rows = ops.select("doc", "export_pos", schema.alias("schema_json"), F.coalesce(F.try_variant_get("op", "$.requestBody.required", "boolean"), F.lit(False)).alias("must"), _text("op", "$.requestBody.description").alias("about")).where("schema_json IS NOT NULL")
    props = F.from_json(F.get_json_object("schema_json", "$.properties"), "map<string,string>")
    need = F.from_json(F.get_json_object("schema_json", "$.required"), "array<string>")
    flat = rows.where(F.size(props) > 0).select("doc", "export_pos", need.alias("need"), F.posexplode(F.map_entries(props)).alias("pos", "e"))
    flat = flat.select("doc", "export_pos", F.lit(2).alias("level"), "pos", F.lit("body").alias("place"), F.col("e.key").alias("name"), F.coalesce(F.array_contains("need", F.col("e.key")), F.lit(False)).alias("required"), F.get_json_object("e.value", "$.description").alias("description"), F.col("e.value").alias("schema_json"))
    one = rows.where(F.coalesce(F.size(props), F.lit(0)) <= 0).select("doc", "export_pos", F.lit(2).alias("level"), F.lit(0).alias("pos"), F.lit("body").alias("place"), F.lit("body").alias("name"), F.col("must").alias("required"), F.col("about").alias("description"), "schema_json")
    return flat.unionByName(one)


def responses(ops: DataFrame) -> DataFrame:
    """Schema and description of each operation's success: the lowest 2xx code, else the default."""
    codes = F.map_keys(F.from_json(_json("op", "$.responses"), "map<string,string>"))
    code = F.coalesce(F.array_min(F.filter(codes, lambda k: k.rlike("^2(\\d\\d|XX)$"))), F.when(F.array_contains(codes, "default"), F.lit("default")))
    body = F.try_element_at(F.from_json(_json("op", "$.responses"), "map<string,string>"), code)
    return ops.select("doc", "export_pos", code.alias("code"), F.coalesce(_media(F.try_parse_json(body), "$.content"), F.lit('"void"')).alias("schema_json"), F.get_json_object(body, "$.description").alias("description"))


def types(parsed: DataFrame) -> DataFrame:
    """Named component schemas, with their references inlined."""
    parsed.where("valid").select("doc", "v").createOrReplaceTempView("__rest_types")
    rows = parsed.sparkSession.sql("SELECT doc, t.pos AS type_pos, t.key AS name, to_json(t.value) AS schema_json, to_json(v) AS whole FROM __rest_types, LATERAL variant_explode(variant_get(v, '$.components.schemas')) t")
    return rows.select("doc", "type_pos", "name", inline_references("schema_json", "whole", F.concat(F.lit("#/components/schemas/"), F.col("name"))).alias("schema_json"))


def pointers(parsed: DataFrame) -> DataFrame:
    """(doc, pointer, node_json) of all components: what a reference is looked up in."""
    parsed.where("valid").select("doc", "v").createOrReplaceTempView("__rest_pointers")
    return parsed.sparkSession.sql("""
      SELECT doc, concat('#/components/', g.key, '/', replace(replace(t.key, '~', '~0'), '/', '~1')) AS pointer, to_json(t.value) AS node_json
      FROM __rest_pointers, LATERAL variant_explode(variant_get(v, '$.components')) g, LATERAL variant_explode(g.value) t""")


def resolve(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (doc, ref) with their node; ``node_json`` is null where a reference dangles or leaves the document.

    The texts of nodes are far larger than the optimizer's estimate, which is that of the files
    they come from, so they are never broadcast.
    """
    return refs.join(known.withColumnRenamed("pointer", "ref").hint("merge"), ["doc", "ref"], "left")


def inline(node, root, seen: frozenset[str]):
    """A node with local references replaced by their targets; a reference to one of ``seen`` stays."""
    if isinstance(node, list):
        return [inline(x, root, seen) for x in node]
    if not isinstance(node, dict):
        return node
    ref = node.get("$ref")
    if not isinstance(ref, str):
        return {k: inline(v, root, seen) for k, v in node.items()}
    if not ref.startswith("#/") or ref in seen:
        return node
    at = root
    for part in ref[2:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[part] if isinstance(at, dict) and part in at else (at[int(part)] if isinstance(at, list) and part.isdigit() and int(part) < len(at) else None)
        if at is None:
            raise KeyError(f"nothing at {ref}")
    out = inline(at, root, seen | {ref})
    if not isinstance(out, dict):
        return out
    if "/schemas/" in ref and "title" not in out:
        out = {"title": ref.rsplit("/", 1)[1], **out}
    return out | {k: inline(v, root, seen) for k, v in node.items() if k != "$ref"}


@F.pandas_udf(T.StringType())
def _inline(schema: pd.Series, whole: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else json.dumps(inline(json.loads(s), json.loads(w), frozenset([o]))) for s, w, o in zip(schema, whole, own)])


def inline_references(schema: Column | str, whole: Column | str, own: Column) -> Column:
    return _inline(schema, whole, own)


def display_type(schema, depth: int = 0) -> str:
    """A schema as people write it: name, union of arms, ``item[]``, title or type."""
    if isinstance(schema, str):
        return schema
    if not isinstance(schema, dict) or depth > 3:
        return "unknown"
    if isinstance(schema.get("$ref"), str):
        return schema["$ref"].rsplit("/", 1)[-1]
    arms = schema.get("anyOf") or schema.get("oneOf")
    if arms:
        return " | ".join(dict.fromkeys(display_type(a, depth + 1) for a in arms))
    if schema.get("type") == "array":
        return f"{display_type(schema.get('items', 'unknown'), depth + 1)}[]"
    return schema.get("title") or (schema["type"] if isinstance(schema.get("type"), str) else "unknown")
