"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), ``docs`` with the columns of ``documents``, and
returns a DataFrame; ``run`` writes each stage's result as Parquet in the shared folder and
hands the table that it reads back to the next stage. What a stage has written on its way is
deleted once its result is whole.

Defined results, in all stages: an empty table gives an empty one; null and empty texts and
texts without letters go with the first stage, so later ones meet them only if they are called by
themselves, and then keep them; a null id stands for itself and is kept; of rows that repeat
an id one stays after the second stage; extra columns are kept by all stages but the last,
whatever their names; very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclattice.llm import common, decontaminate, language_id, near_dedup, packing, queries, secret_scan


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages, one or several; those without letters, null and empty texts go, and all if no language was learned."""
    common.prepare(spark)
    return language_id.keep_identified(docs, queries.language_model(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, one row of it; texts without words are kept, as are null ids."""
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null texts have none, and an empty benchmark leaves all."""
    return decontaminate.drop_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark and ``n_chars`` brought up to date; null texts stay null."""
    return secret_scan.redact(docs, queries.vocabulary("byte_bpe_50k.tiktoken"), length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 1024 tokens; a null or empty text is one piece, its end id."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Language models, near-duplicate components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        mark = len(common.MADE)
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard_since(mark, docs)
        if before is not None:
            common.discard(before)
        before = docs
    return docs
