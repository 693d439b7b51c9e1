"""S5, S13, H6 for single files: their sheets, a page of rows, the detected header row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import headers as H
from ledgerloom.operators.detect import detect_header_row
from ledgerloom.sources.csvrows import csv_raw_rows
from ledgerloom.sources.files import csv_sheets, list_files
from ledgerloom.sources.workbook import read_workbooks, want_sheet, workbook_sheets

KEYS = ["source_file", "source_sheet"]
DETECT_ROWS = 10


def sheets(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, sheet_name, sheet_pos) of every readable source below a folder. Workbooks are listed from their
    directory, no sheet is parsed; a CSV file is one sheet."""
    return csv_sheets(list_files(spark, root)).unionByName(workbook_sheets(spark, root)[0])


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None, last: int | None = None) -> DataFrame:
    """The raw rows of one sheet of a file, up to row ``last``; a name that the workbook does not have means its first sheet."""
    if path.lower().endswith(".csv"):
        rows = csv_raw_rows(spark, path)
        return rows if last is None else rows.filter(F.col("row_no") <= last)
    return read_workbooks(spark, [path], want_sheet(sheet, last, fallback=True)).drop("sheet_pos")


def detect(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[str | None, int, DataFrame]:
    """(sheet, header row, canonical headers: pos, h, name) of a file's sheet, from its first rows."""
    raw = sheet_rows(spark, path, sheet, DETECT_ROWS).cache()
    found = detect_header_row(raw, DETECT_ROWS).first()
    row = int(found["header_row"]) if found else 1
    canon = H.canonicalize(H.header_long(raw.filter(F.col("row_no") == row), KEYS), KEYS, materialize=True)
    raw.unpersist()
    return (found["source_sheet"] if found else None), row, canon


def preview(spark: SparkSession, path: str, sheet: str | None = None, header_row: int = 1, offset: int = 0, limit: int = 100) -> DataFrame:
    """Data rows ``offset`` to ``offset + limit`` of a file's sheet, with their total."""
    from ledgerloom.plans.adhoc import preview_source
    return preview_source(sheet_rows(spark, path, sheet), header_row, offset, limit)
