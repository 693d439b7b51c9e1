"""Workbook checks: S4-S11 through the clean stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, BigTableField, Rule, RuleField, RuleSource
from ledgerloom.operators import detect as D
from ledgerloom.sources.workbook import emit_workbooks, shape_rows, sheet_bounds
from ledgerloom.suite.common import clean_folder, path_part
from ledgerloom.suite.xlsx_fixture import GAP_EVERY, orders_workbooks

ORACLES: dict[str, str] = {}
RF = RuleField

WB_RULE = Rule("wb", [RuleSource("**/*.xlsx", 3, sheet_name="orders")], [
    RF("订单号", "order_key", 0), RF("借方金额", "debit", 1, True, ["coerce_cents"]),
    RF("日期", "date", 2, True, ["coerce_date"]), RF("摘要", "note", 3), RF("状态", "status", 4, True, ["coerce_string"]),
    RF("标志", "flag", 5), RF("错误", "err", 6), RF("备注", "remark", 7)])
WB_TABLE = BigTableConfig("wb", "orders_wb", [BigTableField("order_key", "INTEGER"), BigTableField("debit", "INTEGER")])

# physical row of the i-th (0-based) order of a workbook, and the gap rows
_NUMBERED = f"""
numbered AS (SELECT o.*, row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 4 ORDER BY o_orderkey) - 1 AS i
             FROM orders o),
placed AS (SELECT *, 4 + i + i // {GAP_EVERY} AS p FROM numbered)"""


def workbook_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed cells from shared / inline strings, numbers, booleans and
    errors (an error in the last column reads as an empty trailing cell, so it is
    trimmed and maps to NULL); header in row 3; missing rows kept as empty rows with lineage; a
    lone far-right cell and a header-only column cut by the bounds rule."""
    folder = orders_workbooks(spark, sf_dir)
    _, _, df = clean_folder(spark, folder, [WB_RULE], WB_TABLE)
    return df.select("order_key", "debit", "date", "note", "status", "flag", "err", "remark",
                     path_part("__source_file", "prio").alias("prio"), "__source_sheet", "__source_row")


ORACLES["workbook_clean"] = f"""
WITH {_NUMBERED}
SELECT o_orderkey AS order_key, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS debit,
  strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority || chr(13) AS note, o_orderstatus AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS flag,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS err,
  CAST(NULL AS VARCHAR) AS remark, o_orderpriority AS prio, 'orders' AS __source_sheet, CAST(p AS BIGINT) AS __source_row
FROM placed
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, o_orderpriority, 'orders', CAST(p - 1 AS BIGINT)
FROM placed WHERE i > 0 AND i % {GAP_EVERY} = 0"""


def sheet_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No sheet name -> first sheet; sheet index; a missing sheet skips the file."""
    folder = orders_workbooks(spark, sf_dir)
    rules = [Rule("first", [RuleSource("**/*.xlsx", 1)], [RF("订单导出", "title", 0)]),
             Rule("by_index", [RuleSource("**/*.xlsx", 3, sheet_index=1)], [RF("订单号", "order_key", 0)]),
             Rule("missing", [RuleSource("**/*.xlsx", 2, sheet_name="nope")], [RF("订单号", "never", 0)])]
    cfg = BigTableConfig("pick", "p", [BigTableField("order_key", "INTEGER")])
    _, _, df = clean_folder(spark, folder, rules, cfg)
    return df.filter(F.col("title").isNotNull() | F.col("order_key").isNotNull()) \
             .select("title", "order_key", "never", "__source_sheet", "__source_row")


ORACLES["sheet_pick"] = f"""
WITH {_NUMBERED}
SELECT 'see orders' AS title, CAST(NULL AS BIGINT) AS order_key, CAST(NULL AS VARCHAR) AS never,
       '说明' AS __source_sheet, CAST(2 AS BIGINT) AS __source_row
FROM (SELECT DISTINCT o_orderpriority, o_orderkey % 4 FROM orders)
UNION ALL
SELECT NULL, o_orderkey, NULL, 'orders', CAST(p AS BIGINT) FROM placed"""


def workbook_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sheet, last row with a value (dimension-capped) and the real
    column count (columns with at least two values)."""
    folder = orders_workbooks(spark, sf_dir)
    sheets = emit_workbooks(spark, folder).filter(F.col("rec") == "sheet")
    return sheet_bounds(sheets).select(path_part("source_file", "prio").alias("prio"),
                                       path_part("source_file", "b").cast("int").alias("b"),
                                       "source_sheet", "row_end", "n_cols")


ORACLES["workbook_bounds"] = f"""
WITH {_NUMBERED}
SELECT o_orderpriority AS prio, CAST(o_orderkey % 4 AS INTEGER) AS b, 'orders' AS source_sheet,
       CAST(MAX(p) AS BIGINT) AS row_end, 7 AS n_cols FROM placed GROUP BY 1, 2
UNION ALL
SELECT DISTINCT o_orderpriority, CAST(o_orderkey % 4 AS INTEGER), '说明', CAST(2 AS BIGINT), 1 FROM orders"""


def workbook_header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 on workbooks: the title row loses to the header row (row 3)."""
    folder = orders_workbooks(spark, sf_dir)
    raw, _, _ = shape_rows(emit_workbooks(spark, folder))
    det = D.detect_header_row(raw.filter(F.col("source_sheet") == "orders"))
    return det.select(path_part("source_file", "prio").alias("prio"),
                      path_part("source_file", "b").cast("int").alias("b"), "header_row", "score")


ORACLES["workbook_header_detect"] = """
SELECT DISTINCT o_orderpriority AS prio, CAST(o_orderkey % 4 AS INTEGER) AS b, 3 AS header_row, 14 AS score FROM orders"""


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unreadable workbook is skipped whole (reported), the rest loads."""
    folder = orders_workbooks(spark, sf_dir, broken=("5-LOW", 3))
    rule = Rule("wb", [RuleSource("**/*.xlsx", 3, sheet_name="orders")], [RF("订单号", "order_key", 0)])
    _, res, df = clean_folder(spark, folder, [rule], BigTableConfig("q", "q", [BigTableField("order_key", "INTEGER")]))
    skipped = sum(1 for w in res.summary.warnings if w.startswith("skipped unreadable file"))
    return df.filter(F.col("order_key").isNotNull()).select("order_key", F.lit(skipped).alias("skipped_files"))


ORACLES["quarantine"] = """
SELECT o_orderkey AS order_key, 1 AS skipped_files FROM orders
WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 4 = 3)"""
