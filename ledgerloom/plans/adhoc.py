"""Ad-hoc SQL with a row cap, table preview pages, source preview."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.pages import page
from ledgerloom.plans.stages import is_reader
from ledgerloom.plans.statements import change_rows, parsed, run_sql
from ledgerloom.plans.workspace import MASTER, Workspace, bt_namespace

DEFAULT_CAP = 5000


@dataclass
class AdhocResult:
    df: DataFrame | None
    truncated: bool = False
    changes: int | None = None


def adhoc(ws: Workspace, sql: str, folder: str | None = None, limit: int | None = None, capped: bool = True) -> AdhocResult:
    """Q5 / Q6: run SQL against master (or one big-table namespace). A reader
    returns at most ``limit`` rows (default 5000); ``truncated`` is exact (the
    cap is applied as ``limit(cap + 1)``, never by editing the SQL text, and the statement
    runs once: those rows are checkpointed); with ``capped=False`` it returns all rows.
    INSERT, UPDATE and DELETE report the rows they added or met; other statements are refused."""
    ns, folders = (bt_namespace(folder), [folder]) if folder else (MASTER, [])
    if not is_reader(sql) or parsed(ws.spark, sql).writes:
        return AdhocResult(None, changes=change_rows(ws, sql, ns, folders))
    df = run_sql(ws, sql, ns, folders)
    if not capped:
        return AdhocResult(df)
    cap = DEFAULT_CAP if limit is None else int(limit)
    head = df.limit(cap + 1).checkpoint()
    n = head.count()
    return AdhocResult(head.limit(cap) if n > cap else head, truncated=n > cap)


def preview_table(ws: Workspace, ns: str, table: str, offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
    """Q7: one page of a stored table, in lineage order when the table has it
    (otherwise in storage order), plus the total row count; the table is not sorted."""
    return page(ws, ns, table, offset, limit)


def preview_source(raw: DataFrame, header_row: int = 1, offset: int = 0, limit: int = 100) -> DataFrame:
    """Data rows after the header, ``offset``/``limit`` per sheet, with the
    per-sheet total of data rows."""
    data = raw.filter(F.col("row_no") > header_row)
    total = data.groupBy("source_file", "source_sheet").agg(F.count(F.lit(1)).alias("total"))
    lo, hi = header_row + 1 + offset, header_row + offset + limit
    page = data.filter((F.col("row_no") >= lo) & (F.col("row_no") <= hi))
    return page.join(total, ["source_file", "source_sheet"])
