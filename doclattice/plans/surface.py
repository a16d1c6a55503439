"""An API surface and its documentation, derived from the driver's tables.

The statements are plain SQL that any engine runs, with table names as parameters: Spark
gets DataFrames for them, the comparison engine its views.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

#: camel case of the two words of a part's name
_NAME = "concat(split_part({n}, ' ', 1), upper(substr(split_part({n}, ' ', 2), 1, 1)), substr(split_part({n}, ' ', 2), 2))"

DERIVED = {
    "exports": f"""
SELECT p_brand AS spec_id, p_partkey AS export_pos, concat('e', CAST(p_partkey AS STRING)) AS export_key, {_NAME.format(n='p_name')} AS name,
  CASE p_type WHEN 'STANDARD' THEN 'function' WHEN 'PROMO' THEN 'class' WHEN 'LARGE' THEN 'interface' WHEN 'ECONOMY' THEN 'type' WHEN 'MEDIUM' THEN 'variable' ELSE 'enum' END AS kind,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 9 = 0 THEN '  ' ELSE p_name END AS description,
  p_size % 7 = 0 AS deprecated, p_size % 11 = 0 AS internal, p_size % 5 = 0 AS tag_deprecated,
  CASE WHEN p_size % 13 = 0 THEN p_type END AS source_package, CASE WHEN p_size % 13 = 0 THEN NULL ELSE concat(p_type, '.ts') END AS source_file,
  CAST(p_size AS INT) AS source_line, CAST(p_size AS INT) AS size
FROM {{part}}""",
    "params": """
SELECT concat('e', CAST(l_partkey AS STRING)) AS export_key, l_linenumber % 2 AS sig_pos,
  ((l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey) * 64 + CAST(floor(l_quantity) AS BIGINT) AS param_pos,
  concat('arg', CAST(l_suppkey % 10 AS STRING)) AS name,
  CASE l_returnflag WHEN 'A' THEN 'string' WHEN 'N' THEN 'Array< number >' ELSE 'void' END AS type,
  l_linestatus = 'O' AS required
FROM {lineitem} WHERE l_linenumber <= 4""",
    "doc_params": """
SELECT concat('e', CAST(l_partkey AS STRING)) AS export_key,
  ((l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey) * 64 + CAST(floor(l_quantity) AS BIGINT) AS tag_pos,
  CASE WHEN l_linenumber = 5 THEN concat('arg', CAST(l_suppkey % 10 AS STRING), 'x') WHEN l_linenumber = 6 THEN concat('arg', CAST(l_suppkey % 10 AS STRING), '.field') ELSE concat('arg', CAST(l_suppkey % 10 AS STRING)) END AS name,
  CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity > 25 THEN 'Array<number>' WHEN l_quantity > 10 THEN 'string' ELSE 'undefined' END AS type,
  l_tax > 0.04 AS optional
FROM {lineitem} WHERE l_linenumber >= 4""",
    "returns": """
SELECT concat('e', CAST(ps AS STRING)) AS export_key, CASE k % 4 WHEN 0 THEN 'Promise<string>' WHEN 1 THEN 'string' WHEN 2 THEN 'void' ELSE 'Promise< number >' END AS actual_type,
  CASE k % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'undefined' WHEN 2 THEN 'Promise<string>' WHEN 3 THEN NULL ELSE 'Promise<number>' END AS doc_type, k % 3 = 0 AS async_tag, k % 2 = 0 AS async_flag
FROM (SELECT l_partkey AS ps, min(l_orderkey) AS k FROM {lineitem} GROUP BY l_partkey) t""",
    "members": """
SELECT p_brand AS class, concat('m', CAST(s_suppkey AS STRING), '_', CAST(p_size % 7 AS STRING)) AS member, p_partkey AS version_key,
  CASE s_nationkey % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'property' ELSE 'accessor' END AS kind, concat('(', CAST(p_size % 3 AS STRING), ')') AS signature
FROM {part} JOIN {supplier} ON s_suppkey = p_partkey % 10""",
    "history": """
SELECT event_id AS seq, CAST(ts AS DATE) AS date, event_type AS package, CAST(least(100.0, floor(value)) AS INT) AS coverage, CAST(user_id % 4 AS INT) AS lint
FROM {events}""",
}


def sources(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in Formatter().parse(sql) if f})


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; its scans read the columns it needs."""
    sql = DERIVED[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sources(sql)})


def with_derived(sql: str, *names: str) -> str:
    """SQL text for the comparison engine: the derived tables as common table expressions before ``sql``."""
    parts = [f"{n} AS ({DERIVED[n].format(**{t: t for t in sources(DERIVED[n])})})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    if body.upper().startswith("WITH RECURSIVE"):
        raise ValueError("put the recursive part into a subquery")
    return f"WITH {', '.join(parts)} {body}"
