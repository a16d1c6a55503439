"""Tables whose extra columns differ from the operators' own in nothing but case, or have hidden columns' names."""

from __future__ import annotations

import pytest
from doclattice.llm import bm25_search, common, decontaminate, language_id, license_scan, near_dedup, packing, queries, repeat_dedup, secret_scan, token_stream, url_filter

from .cases import prose

COLUMNS = ["doc_id", "text", "TEXT", "Doc_ID", "lang", "_metadata", "c0", "gone", "text "]


@pytest.fixture
def docs(spark):
    rows = [(k, prose(k % 4, 60), "other", "x", "en" if k % 2 else "de", "m", 1, 2, "z") for k in range(12)]
    return spark.createDataFrame(rows, "a bigint, b string, c string, d string, e string, f string, g int, h int, i string").toDF(*COLUMNS)


def test_operators(spark, docs):
    tokenizer, ranks = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken")
    benchmark = spark.createDataFrame([(1, prose(1, 12), "z")], "item_id bigint, text string, TEXT2 string").toDF("item_id", "text", "TEXT")
    model = queries.language_model(docs)
    assert language_id.detect(docs, model).count() == license_scan.scan(docs).count() == secret_scan.scan(docs, ranks).count() == 12
    assert packing.pack(docs, tokenizer).count() == repeat_dedup.remove_repeats(docs).count() == 12
    shards = token_stream.write(docs, tokenizer, common.scratch(spark, "t"), shards=2)
    assert token_stream.read(spark, shards).count() == 12
    assert {r.query_id for r in bm25_search.search(docs).collect()} == {0}
    assert sorted(r[0] for r in near_dedup.drop_near_duplicates(docs).collect()) == [0, 1, 2, 3]
    assert decontaminate.report(docs, benchmark).where("contaminated").count() == 3
    for kept in (near_dedup.drop_near_duplicates(docs), decontaminate.drop_contaminated(docs, benchmark), language_id.keep_identified(docs, model, 0.0), secret_scan.redact(docs, ranks)):
        assert kept.columns == COLUMNS and kept.count() in (4, 9, 12)
    pages = spark.createDataFrame([(1, "http://a.com/en/", "x", "y")], "p bigint, u string, v string, h string").toDF("page_id", "url", "URL", "host")
    assert url_filter.judge(pages, queries.URL_RULES).first().verdict == "block"


def test_very_long_texts(spark):
    """Nothing of a text of some megabytes is cut: what stands at its end is found, and its copy is one."""
    end = " MIT license follows: Released under the MIT License. password=abcdefgh1234 " + prose(999, 30)
    text = " ".join(f"{prose(k, 1500)} number{k}" for k in range(300)) + end
    assert len(text) > 3 << 20
    docs = spark.createDataFrame([(0, text, "en"), (50, text, "de"), (3, end, "de"), (4, None, None)], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert found[0].licenses == ["MIT notice"] and found[0].matches[0].end == text.index("MIT License.") + 11
    secrets = {r.doc_id: r for r in secret_scan.scan(docs, queries.vocabulary("byte_bpe_50k.tiktoken")).collect()}
    at = text.index("password=")
    assert secrets[0].n_assign == 1 and f"assign:{at}:{at + 21}" in secrets[0].spans
    benchmark = spark.createDataFrame([(1, prose(999, 30))], "item_id bigint, text string")
    hits = {r.doc_id: r for r in decontaminate.report(docs, benchmark).collect()}
    assert hits[0].n_hit == hits[3].n_hit == 30 and not hits[4].contaminated
    groups = {r.doc_id: r.component_id for r in near_dedup.group(docs).collect()}
    assert groups[0] == groups[50] == 0 and groups[3] == 3
    best = {(r.query_id, r.rank): r.doc_id for r in bm25_search.search(docs, k=2).collect()}
    assert {best[0, 1], best[0, 2]} == {0, 50}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeat_dedup.remove_repeats(docs).collect()}
    assert removed[50][0] == removed[50][1] == len(text.encode()) and removed[3][1] > 200
    langs = {r.doc_id: r.lang_pred for r in language_id.detect(docs, language_id.fit(docs)).collect()}
    assert langs[4] == "und" and langs[0] in ("de", "en")
