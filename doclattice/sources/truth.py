"""One entry for surfaces of any kind: REST documents, contracts, spec files, as one table of exports."""

from __future__ import annotations

from urllib.parse import urlparse
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contracts, files, rest_documents

COLUMNS = ["spec_id", "export_pos", "export_key", "name", "kind", "description"]
TIMEOUT = 30


def read_document(spark: SparkSession, place: str) -> DataFrame:
    """(doc, content) of a document in any file system, or behind an address; an answer other than success is an error."""
    if urlparse(place).scheme not in ("http", "https"):
        return rest_documents.load(spark, place)
    with urlopen(place, timeout=TIMEOUT) as answer:
        return spark.createDataFrame([(place, answer.read().decode())], "doc string, content string")


def from_rest(docs: DataFrame) -> DataFrame:
    """Operations as functions; a document is named by the end of its place, without what follows the first dot."""
    ops = rest_documents.operations(rest_documents.parse(docs))
    name = F.regexp_extract("doc", r"([^/]+?)(?:\.[^/]*)?$", 1)
    return ops.select(name.alias("spec_id"), F.col("export_pos").cast("bigint").alias("export_pos"), F.col("name").alias("export_key"), "name", F.lit("function").alias("kind"), "description")


def from_contracts(abis: DataFrame, docs: DataFrame) -> DataFrame:
    """Functions, maps, variables, tokens and traits."""
    x = contracts.exports(abis, docs)
    return x.select(F.col("contract").alias("spec_id"), (F.col("section") * 10_000 + F.col("pos")).cast("bigint").alias("export_pos"), F.concat_ws(".", "contract", "name").alias("export_key"), "name", "kind", "description")


def load(spark: SparkSession, specs: list[str] = (), rest: list[str] = (), abis: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Exports of all sources that are given, with the kind of source each comes from."""
    parts = [files.specs(spark, p).select("spec_id", F.col("export_pos").cast("bigint").alias("export_pos"), "export_key", "name", "kind", "description").withColumn("lang", F.lit("typescript")) for p in specs]
    parts += [from_rest(read_document(spark, p)).withColumn("lang", F.lit("openapi")) for p in rest]
    if abis is not None:
        none = spark.createDataFrame([], "contract string, name string, description string")
        parts.append(from_contracts(abis, none if docs is None else docs).withColumn("lang", F.lit("clarity")))
    if not parts:
        raise ValueError("no source is given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
