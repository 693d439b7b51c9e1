"""SQL stages: sql-clean (M3) and query (M4) with Q1-Q4 guards.

User SQL is Spark SQL with double-quoted identifiers (as in the reference's
SQL dialect); its table names are resolved in the workspace (Q3,
``plans/statements.py``). Results are written as a new table version, so a query
may read its own result table.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ledgerloom.config import ConfigError, QueryPipeline, SqlCleanPipeline, validate_pipeline
from ledgerloom.plans.statements import parsed, run_sql
from ledgerloom.plans.workspace import MASTER, RunSummary, Workspace, bt_namespace, slug

_READER = re.compile(r"^(select|with)\b", re.IGNORECASE)


class NotCleanedError(RuntimeError):
    code = "SQL_CLEAN_TABLE_NOT_CLEANED"


def is_reader(sql: str) -> bool:
    """Q1: trimmed SQL must start with SELECT or WITH."""
    return bool(_READER.match(sql.strip()))


def guard_reader(sql: str, spark: SparkSession | None = None) -> None:
    """Q1. With a session, the parsed statement is looked at too: a write can
    follow a WITH clause."""
    if not sql or not sql.strip():
        raise ConfigError("SQL_REQUIRED", "sql is empty")
    if not is_reader(sql) or (spark is not None and parsed(spark, sql).writes):
        raise ConfigError("SQL_NOT_READONLY", "only SELECT / WITH statements are allowed here")


def sql_clean(ws: Workspace, p: SqlCleanPipeline, big_table_names: dict[str, str]) -> RunSummary:
    """M3: user SQL over the listed big tables -> ``master.<result_table>``.
    ``big_table_names``: folder -> table name (Q4 checks each exists)."""
    validate_pipeline(p)
    guard_reader(p.sql, ws.spark)
    for f in p.big_tables:
        t = big_table_names.get(f)
        if t is None or not ws.exists(bt_namespace(f), t):
            raise NotCleanedError(f"{NotCleanedError.code}: big table folder {f!r} has not been cleaned")
    rows, _ = ws.write_table(run_sql(ws, p.sql, MASTER, p.big_tables), MASTER, p.result_table)
    s = RunSummary(p.id, "sql-clean", True, rows, result_table=f"{MASTER}.{slug(p.result_table)}")
    ws.log_run(s)
    return s


def run_query(ws: Workspace, p: QueryPipeline) -> RunSummary:
    """M4: user SQL over master -> materialised ``master.<result_table>`` (CTAS
    through a staged version, so reading the result table itself works)."""
    if not p.sql or not p.sql.strip():
        raise ConfigError("SQL_REQUIRED", f"{p.id}: sql is empty")
    if not p.result_table:
        raise ConfigError("RESULT_TABLE_REQUIRED", f"{p.id}: result table is empty")
    guard_reader(p.sql, ws.spark)
    rows, _ = ws.write_table(run_sql(ws, p.sql), MASTER, p.result_table)
    s = RunSummary(p.id, "query", True, rows, result_table=f"{MASTER}.{slug(p.result_table)}")
    ws.log_run(s)
    return s
