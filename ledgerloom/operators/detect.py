"""Header scoring, header-row detection, stacked-table header
candidates and the automatic mapping guess, as DataFrame jobs over ``raw_rows``
(``source_file, source_sheet, row_no, cells, kinds``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import js_trim
from ledgerloom.plans.sizing import broadcast_if_small

NUMERIC_CELL = "^-?[0-9]+([.,][0-9]+)?$"
# Header words that mark an amount column (case-insensitive).
AMOUNT_HEADER_RE = "(?i)金额|借方|贷方|余额|amount|amt"
SHEET_KEYS = ["source_file", "source_sheet"]


def cell_score(value: Column, kind: Column) -> Column:
    s = js_trim(F.coalesce(value, F.lit("")))
    return (F.when(value.isNull() | (s == "") | s.rlike(NUMERIC_CELL), F.lit(0))
             .when(F.coalesce(kind, F.lit("s")) == "s", F.lit(2))
             .otherwise(F.lit(1)))


def row_score(cells: Column, kinds: Column) -> Column:
    """H5: text cell 2, other non-empty cell 1, empty or plain number 0."""
    scores = F.transform(cells, lambda x, i: cell_score(
        x, F.when(kinds.isNull(), F.lit("s")).otherwise(F.substr(kinds, i + 1, F.lit(1)))))
    return F.aggregate(scores, F.lit(0), lambda acc, x: acc + x)


def detect_header_row(raw: DataFrame, scan_rows: int = 10) -> DataFrame:
    """H6: per sheet, the best-scoring row among the first ``scan_rows`` (earliest
    wins); all-zero -> index -1 and header row 1. Output: keys, header_index
    (0-based, -1 when none), header_row (1-based), score."""
    # one aggregate over the first rows: a sheet with rows has a first one
    first = raw.filter(F.col("row_no") <= scan_rows).select(*SHEET_KEYS, "row_no", row_score(F.col("cells"), F.col("kinds")).alias("score"))
    best = first.groupBy(*SHEET_KEYS).agg(F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("row_no")).alias("before")))).alias("b"))
    row = -F.col("b.before")
    return best.select(*SHEET_KEYS, F.coalesce(row - 1, F.lit(-1)).cast("int").alias("header_index"), F.coalesce(row, F.lit(1)).cast("int").alias("header_row"),
                       F.coalesce(F.col("b.score"), F.lit(0)).alias("score"))


def _blank(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(True), lambda acc, x: acc & (js_trim(F.coalesce(x, F.lit(""))) == ""))


def header_candidates(raw: DataFrame, min_score: int = 3, cell_truncate: int = 60) -> DataFrame:
    """H7: rows that look like the header of a stacked table. Trailing blank rows
    are cut, interior blank rows skipped; the baseline is the mode of the row
    scores (ties -> larger score); a candidate has ``score >= min_score``,
    ``score > mode`` and a score seen at most twice. Output per candidate:
    keys, row_no, score, deviation, cells (cut to ``cell_truncate`` chars with an
    ellipsis); rank by deviation desc, row asc (column ``rank``)."""
    # every row is scored once; cells are read again for the candidates only
    rows = raw.select(*SHEET_KEYS, "row_no", _blank(F.col("cells")).alias("blank"), row_score(F.col("cells"), F.col("kinds")).alias("score")).checkpoint()
    full = rows.filter(~F.col("blank"))      # trailing and interior blank rows
    freq = full.groupBy(*SHEET_KEYS, "score").agg(F.count(F.lit(1)).alias("freq")).checkpoint()      # a row per sheet and score
    mode = freq.groupBy(*SHEET_KEYS).agg(F.max_by("score", F.struct("freq", "score")).alias("mode"))
    rare = freq.join(mode, SHEET_KEYS).filter((F.col("score") >= min_score) & (F.col("score") > F.col("mode")) & (F.col("freq") <= 2))
    found = full.join(rare, SHEET_KEYS + ["score"]).select(*SHEET_KEYS, "row_no", "score", (F.col("score") - F.col("mode")).alias("deviation")).checkpoint()
    cut = F.transform("cells", lambda x: F.when(
        F.length(F.coalesce(x, F.lit(""))) > cell_truncate,
        F.concat(F.substring(x, 1, cell_truncate - 1), F.lit("…"))).otherwise(F.coalesce(x, F.lit(""))))
    cells = raw.select(*SHEET_KEYS, "row_no", "cells").join(broadcast_if_small(found, 200_000), SHEET_KEYS + ["row_no"])
    w = Window.partitionBy(*SHEET_KEYS).orderBy(F.desc("deviation"), "row_no")
    return cells.select(*SHEET_KEYS, "row_no", "score", "deviation", cut.alias("cells")).withColumn("rank", F.row_number().over(w))


def guess_mapping(canon: DataFrame) -> DataFrame:
    """Per canonical header, INTEGER + to-cents when it names an amount,
    else TEXT + none; the output name is the canonical header."""
    amount = F.col("name").rlike(AMOUNT_HEADER_RE)
    return canon.select(
        *[c for c in canon.columns if c not in ("name", "h", "cnt")],
        F.col("name").alias("source_header"), F.col("name").alias("output_name"),
        F.when(amount, F.lit("INTEGER")).otherwise(F.lit("TEXT")).alias("type"),
        F.when(amount, F.lit("to-cents")).otherwise(F.lit("none")).alias("transform"))
