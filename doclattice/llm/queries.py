"""The queries opN of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import bm25_search, decontaminate, language_id, license_scan, near_dedup, packing, repeat_dedup, secret_scan, token_stream, url_filter


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that no model may learn from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def language_model(documents: DataFrame) -> language_id.Model:
    """Fitted on the documents that are not held out."""
    return language_id.fit(c.keyed(documents, "doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False))))


#: (host, path prefix, block)
URL_RULES = [("com", "/en/", True), ("example.com", "/en/7", False), ("net", "/de/", False), ("example.net", "/de/8", True), ("org", "/es/", True)]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(c.read_table(spark, sf_dir, "pages"), URL_RULES)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents")
    found = language_id.detect(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(c.read_table(spark, sf_dir, "documents"))


def op4_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents")
    shards = token_stream.write(docs, vocabulary("byte_bpe_50k.json"), c.scratch(spark, "tokens"))
    return token_stream.read(spark, shards)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(c.read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_search.search(c.read_table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(c.read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(c.read_table(spark, sf_dir, "documents"), c.read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(c.read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_repeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_dedup.remove_repeats(c.read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it builds on this module

    return corpus_pipeline.run(spark, sf_dir)


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c.prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = {"op1_url_filter": op1_url_filter, "op2_language_id": op2_language_id, "op3_license_scan": op3_license_scan, "op4_token_stream": op4_token_stream, "op5_packing": op5_packing, "op6_bm25_search": op6_bm25_search, "op7_near_dedup": op7_near_dedup, "op8_decontaminate": op8_decontaminate, "op9_secret_scan": op9_secret_scan, "op10_repeat_dedup": op10_repeat_dedup, "pipeline": pipeline}
    return {name: _prepared(q) for name, q in all_.items()}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_BM25 = f"""
WITH w AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS t FROM w) GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(ws))::DOUBLE AS mean FROM w),
p AS (SELECT tf.doc_id, tf.t, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / mean)) AS x
  FROM tf JOIN df USING (t) JOIN w USING (doc_id), n),
s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(p.x) AS score FROM tf q JOIN p USING (t) WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) t WHERE rank <= 10"""

_NEAR = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
link AS (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2) x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 70 * (na.n + nb.n - k)),
reach AS (SELECT node, min(place) AS least FROM (WITH RECURSIVE r AS (SELECT doc_id AS node, doc_id AS place FROM documents UNION SELECT r.node, link.b FROM r JOIN link ON link.a = r.place) SELECT * FROM r) t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least AS component_id, d.doc_id = least AS kept FROM documents d JOIN reach ON reach.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT DISTINCT item, p FROM (SELECT CAST(item_id AS VARCHAR) AS item, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws] ELSE list_transform(generate_series(1, len(ws) - 9), lambda i: ws[i:i + 9]) END) AS p FROM (SELECT item_id, {_ALNUM} AS ws FROM benchmark))),
k AS (SELECT DISTINCT len(p) AS k FROM b),
win AS (SELECT doc_id, k, unnest(generate_series(1, len(ws) - k + 1)) AS i, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: ws[i:i + k - 1])) AS p FROM d, k WHERE len(ws) >= k),
occ AS (SELECT doc_id, i, k, item FROM win JOIN b USING (p)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS place FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, coalesce(own.sha, sha256('')) AS items_sha256, hit.n IS NOT NULL AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""

_REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, c * 512 AS place, substr(x, c * 1024 + 1, 1024 + 98) AS x FROM (SELECT doc_id, x, unnest(generate_series(0, length(x) // 1024)) AS c FROM h)),
win AS (SELECT doc_id, place + i AS i, substr(x, 2 * i + 1, 100) AS w FROM (SELECT doc_id, place, x, unnest(generate_series(0, least(511, length(x) // 2 - 50))) AS i FROM part WHERE length(x) >= 100)),
least AS (SELECT w, min(doc_id) AS m FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT win.doc_id, i FROM win JOIN least USING (w) WHERE win.doc_id > m),
run AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM cov)) GROUP BY doc_id, r),
kept AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS from_, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM run),
text_ AS (SELECT kept.doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (s - from_)), '' ORDER BY s) AS head, max(e) AS e, sum(e - s) AS removed, count(*) AS spans FROM kept JOIN h ON h.doc_id = kept.doc_id GROUP BY 1)
SELECT h.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substr(x, 2 * coalesce(e, 0) + 1)))) AS kept_sha256 FROM h LEFT JOIN text_ t ON t.doc_id = h.doc_id"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{'block' if b else 'allow'}')" for h, p, b in URL_RULES)
    return {
        "op1_url_filter": f"""
WITH rules(h, p, v) AS (VALUES {rules}),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, v DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND n = 1""",
        "op6_bm25_search": _BM25,
        "op7_near_dedup": _NEAR,
        "op8_decontaminate": _LEAKS,
        "op10_repeat_dedup": _REPEATS,
    }
