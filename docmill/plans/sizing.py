"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of narrow rows (a key and a few numbers) is broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``; else unhinted,
    so that the join shuffles and AQE may split skewed partitions."""
    return F.broadcast(df) if rows <= limit else df
