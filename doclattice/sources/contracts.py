"""Contract interfaces (ABI as JSON, with doc comments) to surface tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABI = """struct<functions:array<struct<name:string,access:string,args:array<struct<name:string,type:string>>,outputs:struct<type:string>>>,
maps:array<struct<name:string,key:string,value:string>>,variables:array<struct<name:string,access:string,type:string>>,
fungible_tokens:array<struct<name:string>>,non_fungible_tokens:array<struct<name:string,type:string>>,traits:array<struct<name:string>>>"""


def type_schema(t):
    """A contract type as JSON schema: sized texts, lists, tuples as objects, optionals and responses as unions."""
    if isinstance(t, str):
        return {"int128": "int", "uint128": "uint", "bool": "boolean", "principal": "principal", "none": "null", "trait_reference": "trait"}.get(t, t if t else "unknown")
    if not isinstance(t, dict) or len(t) != 1:
        return "unknown"
    (kind, body), = t.items()
    if kind == "buffer":
        return {"type": "buffer", "maxLength": body.get("length")}
    if kind in ("string-ascii", "string-utf8"):
        return {"type": "string", "encoding": kind[7:], "maxLength": body.get("length")}
    if kind == "list":
        return {"type": "array", "items": type_schema(body.get("type")), "maxItems": body.get("length")}
    if kind == "tuple":
        return {"type": "object", "properties": {f["name"]: type_schema(f["type"]) for f in body}, "required": [f["name"] for f in body]}
    if kind == "optional":
        return {"anyOf": [type_schema(body), {"type": "null"}]}
    if kind == "response":
        return {"type": "response", "ok": type_schema(body.get("ok")), "error": type_schema(body.get("error"))}
    return "unknown"


@F.pandas_udf(T.StringType())
def schema_json(types: pd.Series) -> pd.Series:
    """JSON text of a type to JSON text of its schema."""

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(type_schema(json.loads(x)))
        except ValueError:
            return json.dumps(type_schema(x))

    return pd.Series([one(x) for x in types])


def exports(abis: DataFrame, docs: DataFrame) -> DataFrame:
    """Functions, maps, variables, tokens and traits of contracts (contract, abi) with their comments (contract, name, description, tags)."""
    a = abis.select("contract", F.from_json("abi", ABI).alias("a"))
    part = lambda field, kind, access=F.lit(None): a.select("contract", F.posexplode(f"a.{field}").alias("pos", "x")).select("contract", F.lit(kind).alias("kind"), "pos", F.col("x.name").alias("name"), access.cast("string").alias("access"))
    access = F.col("x.access")
    parts = [part("functions", "function", access), part("maps", "map"), part("variables", "variable", access), part("fungible_tokens", "token"), part("non_fungible_tokens", "token"), part("traits", "trait")]
    out = parts[0].withColumn("section", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("section", F.lit(k)))
    return out.where("kind <> 'function' OR access <> 'private'").join(docs, ["contract", "name"], "left")


def params(abis: DataFrame) -> DataFrame:
    """Parameters of functions, all of them required."""
    a = abis.select("contract", F.explode(F.from_json("abi", ABI)["functions"]).alias("f"))
    return a.select("contract", F.col("f.name").alias("function"), F.posexplode("f.args").alias("param_pos", "p")).select("contract", "function", "param_pos", F.col("p.name").alias("name"), F.lit(True).alias("required"), schema_json("p.type").alias("schema_json"))
