"""Python's ``round(x, d)`` for the few numbers the reference rounds before printing.

Python rounds the exact binary value half-to-even (``round(0.0625, 3) == 0.062``),
which equals parsing ``f"{x:.{d}f}"``; Spark's ``round`` is half-up on the shortest
decimal form (0.063) and ``bround`` misses cases whose binary value is just above a
tie.  No JVM built-in reproduces the Python rule, so this helper is Arrow-batched
and used only on small aggregated tables (class shares, per-fold accuracies,
leaderboard cells).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _make(d: int):
    @F.pandas_udf(DoubleType())
    def _round(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else float(f"{v:.{d}f}"))
    return _round


_ROUNDERS = {d: _make(d) for d in range(0, 7)}


def py_round(col, digits: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _ROUNDERS[digits](c.cast("double"))
