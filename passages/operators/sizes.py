"""Broadcasts behind a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows that are broadcast at most, about 12 MB in memory.
FEW = 200_000


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """Marks a narrow side for broadcast if it has at most `limit` rows, counted no further than that; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
