"""Registry of named queries and their DuckDB oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver's
tables (through the stand-in views).  The oracle is an independent SQL text
over the same parquet tables; queries without a SQL form have none.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


# ------------------------------------------------------------- DuckDB stand-ins
PREDICTIONS = """predictions AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_returnflag AS model,
         l_linestatus AS lang, CAST(l_partkey % 2 AS INTEGER) AS tuned,
         CAST(l_linenumber - 1 AS INTEGER) AS y_true,
         CAST(CASE WHEN l_quantity >= 49 THEN -1 ELSE CAST(l_quantity AS INTEGER) % 7 END AS INTEGER) AS y_pred,
         CAST(l_suppkey % 4 AS INTEGER) AS fold
  FROM lineitem)"""

CORPUS = """corpus AS (
  SELECT doc_id, text AS src, lang, source AS problem, CAST(n_chars % 7 AS INTEGER) AS label
  FROM documents)"""

CALL_EDGES = """edges AS (
  SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS caller, p_partkey AS callee FROM part)"""


def add_oracle(name: str, sql: str) -> None:
    """Attach an oracle to an already registered query."""
    if name not in QUERIES:
        raise KeyError(name)
    ORACLES[name] = sql.strip()
