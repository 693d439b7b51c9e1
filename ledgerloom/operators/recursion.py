"""Recursion by semi-naive evaluation.

Each level applies the step to the rows that the level before found for the first time, until a level finds none. With distinct rows
(SQL's ``UNION``) a cycle ends by itself and there is no level limit; with ``UNION ALL`` a level limit raises instead of ending silently.
A level is one job that ends in a checkpoint, so plans stay short and lost executors cost one level."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels after which what was found is written together; levels of a recursion that keeps repeated rows.
FOLD, ALL_LEVELS = 8, 10_000


class RecursionLimitError(RuntimeError):
    code = "RECURSION_LIMIT"


def _new(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct rows that are not known; NULLs are equal."""
    k = known.toDF(*[f"k{i}" for i in range(len(known.columns))])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(rows.columns)])
    return rows.distinct().join(k, same, "left_anti")


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, max_levels: int | None = None) -> DataFrame:
    """``seed`` and everything that repeated application of ``step`` adds. The step's columns are taken by position
    and cast to the seed's types. Column names must differ."""
    kinds, names = [f.dataType for f in seed.schema.fields], seed.columns
    delta = (seed.distinct() if distinct else seed).checkpoint()
    found, level = [delta], 0
    limit = max_levels if max_levels is not None or distinct else ALL_LEVELS
    while not delta.isEmpty():
        if limit is not None and level >= limit:
            raise RecursionLimitError(f"{RecursionLimitError.code}: more than {limit} levels")
        made = step(delta)
        if len(made.columns) != len(names):
            raise ValueError(f"the step gives {len(made.columns)} columns for {len(names)}")
        made = made.toDF(*[f"c{i}" for i in range(len(names))])
        made = made.select(*[F.col(f"c{i}").cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])
        delta = (_new(made, reduce(DataFrame.unionAll, found)) if distinct else made).checkpoint()
        found.append(delta)
        level += 1
        if len(found) > FOLD:
            found = [reduce(DataFrame.unionAll, found).checkpoint()]
    return reduce(DataFrame.unionAll, found)
