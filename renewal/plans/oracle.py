"""DuckDB SQL for the fixture frames and helpers to build the oracle statements.

These are independent restatements of what the Spark operators compute; nothing here is
executed by the library itself.
"""

from __future__ import annotations

from collections.abc import Sequence

RENEWAL_SQL = """
renewal AS (
  WITH pre AS (
    SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend, avg(o_totalprice) AS avg_price,
           max(o_totalprice) AS max_price, max(o_orderdate) AS last_order
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY o_custkey),
  post AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
  SELECT c.c_custkey AS row_id,
    CASE WHEN c.c_custkey % 4 = 3 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN c.c_custkey % 10 = 3 THEN NULL ELSE c.c_acctbal END AS acctbal,
    pre.n_orders, pre.spend, pre.avg_price, pre.max_price,
    date_diff('day', pre.last_order, TIMESTAMP '2000-01-01') AS recency_days,
    CAST(c.c_nationkey AS DOUBLE) AS nation,
    CAST(1 AS DOUBLE) AS const_col,
    CASE WHEN c.c_custkey % 4 <> 3 THEN CAST(c.c_custkey % 5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS const_in_test,
    CAST(NULL AS DOUBLE) AS all_null,
    CASE WHEN c.c_custkey % 2 = 0 THEN NULL ELSE CAST((c.c_custkey * 7919) % 101 AS DOUBLE) END AS sparse_col,
    CASE WHEN c.c_custkey % 11 = 5 THEN NULL ELSE c.c_mktsegment END AS segment,
    CAST(CASE WHEN post.o_custkey IS NULL THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM customer c
  LEFT JOIN pre ON pre.o_custkey = c.c_custkey
  LEFT JOIN post ON post.o_custkey = c.c_custkey
)"""

EMBED_SQL = (
    "embed AS (SELECT vec_id AS row_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(64))
    + ", CAST(CASE WHEN label = 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM embeddings)"
)

DIRTY_SQL = """
dirty AS (
  SELECT CAST(c_custkey AS VARCHAR) AS row_id, CAST(c_nationkey AS VARCHAR) AS feature_0,
    CASE c_custkey % 7 WHEN 0 THEN '#' WHEN 1 THEN 'abc' WHEN 2 THEN '1d' WHEN 3 THEN '1_0'
      WHEN 4 THEN ' 12 ' WHEN 5 THEN 'NaN' ELSE CAST(c_custkey AS VARCHAR) END AS feature_6,
    CASE WHEN c_custkey % 9 = 4 THEN '#' ELSE CAST(c_custkey % 3 AS VARCHAR) END AS feature_13,
    CAST(c_custkey % 2 AS VARCHAR) AS feature_14,
    CASE c_custkey % 5 WHEN 0 THEN '#' WHEN 1 THEN 'a#' WHEN 2 THEN 'NA' WHEN 3 THEN '' ELSE c_mktsegment END AS feature_36,
    CAST(CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS target
  FROM customer
)"""

DOCQ_SQL = """
docq AS (
  SELECT l.doc_id AS row_id, d.lang, d.source, d.n_chars, CAST(length(d.text) AS BIGINT) AS len_text,
    CAST(len(string_split(d.text, ' ')) AS BIGINT) AS n_words, CAST(l.quality AS DOUBLE) AS quality,
    CAST(l.toxic AS INTEGER) AS label
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
)"""

NUMERIC_TEXT_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def hash_sql(seed: int | str, *exprs: str) -> str:
    """DuckDB twin of ``functions.hash_u32``."""
    parts = [f"'{seed}'"]
    for e in exprs:
        parts += ["':'", f"CAST({e} AS VARCHAR)"]
    return f"CAST(('0x' || substr(md5(concat({', '.join(parts)})), 1, 8)) AS UBIGINT)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def rounded(sql: str, doubles: Sequence[str], places: int = 6) -> str:
    """Wrap a statement so the named double columns are rounded like the Spark side."""
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, {places}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS q"
