"""Helpers shared by the registered checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, CleanPipeline, Rule
from ledgerloom.operators.clean import CleanResult, clean
from ledgerloom.plans.workspace import Workspace

# fixed extraction time so repeated runs give identical lineage columns
FIXED_EXTRACTED_AT = "2024-01-01T00:00:00.000Z"


def clean_folder(spark: SparkSession, folder: str, rules: list[Rule], cfg: BigTableConfig,
                 ws: Workspace | None = None) -> tuple[Workspace, CleanResult, DataFrame]:
    ws = ws or Workspace(spark)
    res = clean(ws, CleanPipeline(f"clean_{cfg.folder}", folder, cfg.folder), rules, cfg,
                extracted_at=FIXED_EXTRACTED_AT)
    return ws, res, ws.read(res.namespace, res.table)


def path_part(col: str, key: str) -> Column:
    """Value of a ``key=value`` folder in a lineage path."""
    return F.regexp_extract(F.col(col), f"/{key}=([^/]+)/", 1)


# SQL fragment (DuckDB) for the cents a 2-decimal money text turns into.
def sql_cents(expr: str) -> str:
    return f"CAST(floor(CAST(CAST({expr} AS DECIMAL(18,2)) AS VARCHAR)::DOUBLE * 100 + 0.5) AS BIGINT)"
