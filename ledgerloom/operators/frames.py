"""Window frames counted in groups of peers, which Spark's SQL does not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[str | Column], start: int, end: int, **aggregates: Column) -> DataFrame:
    """``df`` with each aggregate over ``GROUPS BETWEEN start AND end`` (negative: preceding; ``Window.unboundedPreceding`` and
    ``unboundedFollowing`` too): rows equal in ``order`` are one group. The groups are numbered by ``dense_rank`` and the frame is a range of
    their numbers, in the same shuffle."""
    number = "__group_number"
    ranked = df.withColumn(number, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    frame = Window.partitionBy(*partition).orderBy(number).rangeBetween(start, end)
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], *[a.over(frame).alias(n) for n, a in aggregates.items()])
