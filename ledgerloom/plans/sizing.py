"""Size-checked broadcast: a side is broadcast only when its row count is known
to be under a bound; otherwise the join stays a shuffle join (AQE may still
convert it at runtime from real statistics, and splits skewed partitions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` must be cheap to count (a checkpointed or small derived table)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
