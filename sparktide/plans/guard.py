"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 10_000


def broadcast_if(df: DataFrame, rows: int | None, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the row count is known and within the limit.

    Without a count, or beyond the limit, the join stays a shuffle join that
    adaptive execution may still improve from measured sizes.
    """
    return F.broadcast(df) if rows is not None and rows <= limit else df
