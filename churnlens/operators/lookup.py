"""Joins to a small table: broadcast behind a check of its size, shuffled beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.ordered import stored

BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` joined to a table of one row per key. It is written once and counted: with few rows it is
    broadcast, so ``df`` isn't shuffled on a key of two or three values; with many, Spark chooses."""
    kept = stored(small, "lookup")
    return df.join(F.broadcast(kept) if kept.count() <= most else kept, list(on), how)
