"""Query catalog: stand-in views, registered queries and their DuckDB oracles."""

from complexa.plans import q_code, q_extract, q_io, q_lexer, q_models, q_scoring, q_splits  # noqa: F401  (registers queries)
from complexa.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
