"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for a broadcast if it has at most so many rows, else as it is, for a join by exchange."""
    counted = df.limit(rows + 1).count()
    return F.broadcast(df) if counted <= rows else df
