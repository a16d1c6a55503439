"""The pipeline, stage by stage against brute force, and the registered queries."""

from __future__ import annotations

import corpus_pipeline
import pytest
from doclattice.llm import queries

from .cases import components, documents, frame, prose
from .test_text_operators import brute_base, brute_decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t) for i, t in documents() if i is not None and i != 100]
    docs += [(800 + k, prose(k, 40) + " password=" + "abcdefgh12" * 2) for k in range(5)]
    docs += [(900, prose(123, 30) + " " + prose(55, 25)), (901, prose(124, 30))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, prose(55, 25))], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/en/1", "<p>")], "page_id bigint, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "secret_scan", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        after = out.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
            continue
        assert out.columns == COLUMNS
        kept = {r.doc_id: r.text for r in after}
        if name == "language_id":
            assert set(before) - set(kept) == {i for i, t in before.items() if not any(ch.isalpha() for ch in t or "")}
        if name == "near_dedup":
            want = components(before.items())
            assert set(kept) == {i for i in before if want[i][1] == i}
        if name == "decontaminate":
            bad = {r[0] for r in brute_decontaminate(before.items(), [(1, prose(55, 25))]) if r[5]}
            assert set(kept) == set(before) - bad and 900 in bad
        if name == "secret_scan":
            assert set(kept) == set(before) and not any(brute_base(t) for t in kept.values())
            assert all(kept[i] == before[i] for i in kept if not brute_base(before[i]))
            assert all(r.n_chars == len(r.text or "") for r in after)
        docs = spark.createDataFrame(after, docs.schema)


def test_stages_on_awkward_rows(spark, sf_dir):
    """Null ids, repeated ids and rows, null, empty and long texts, extra columns with names that operators use."""
    docs = frame(spark, documents() + [(700, prose(70, 60)), (700, prose(71, 60)), (700, prose(71, 60))])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs, sf_dir).columns == columns
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
        if name == "language_id":
            assert all(any(ch.isalpha() for ch in r.text or "") for r in after) and len(after) == sum(any(ch.isalpha() for ch in r.text or "") for r in before)
        elif name == "near_dedup":
            kept = [r.doc_id for r in after if r.doc_id is not None]
            assert len(kept) == len(set(kept)) and {100, 700, 10} <= set(kept) and 11 not in kept
            assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
        else:
            assert len(after) == len(before)
        docs = spark.createDataFrame(after, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []


@pytest.mark.parametrize("number", range(1, 5))
def test_later_stages_by_themselves(spark, sf_dir, number):
    docs = frame(spark, documents())
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, sf_dir).collect()
    silent = {i for i, t in documents() if not (t or "").strip()}
    assert silent <= {r.doc_id for r in out}, name


def test_run_leaves_its_result_alone(spark, sf_dir):
    from doclattice.llm import common

    mark = len(common.MADE)
    rows = corpus_pipeline.run(spark, sf_dir)
    assert len(common.MADE) == mark + 1 and rows.count() > 0


def test_registered_queries(spark, sf_dir):
    columns = {
        "op1": ["page_id", "host", "path", "rule", "verdict"], "op2": ["doc_id", "held_out", "lang_pred", "score"], "op3": ["doc_id"], "op4": ["doc_id", "start", "n_tokens", "ids_crc32"], "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op6": ["query_id", "rank", "doc_id", "score"], "op7": ["doc_id", "n_shingles", "component_id", "kept"], "op8": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op9": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op10": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "pipeline": ["doc_id", "sequence_id"],
    }
    found = queries.queries()
    assert {n.split("_")[0] for n in found} == set(columns)
    for name, q in found.items():
        df = q(spark, sf_dir)
        assert df.columns[: len(columns[name.split("_")[0]])] == columns[name.split("_")[0]] or name == "pipeline"
        assert df.count() > 0
