"""Q7: pages of a stored table without sorting it.

A page of rows in order needs to know where it begins. Rows are counted once per version and group, where a group is a (file,
sheet) of the lineage, or a stored file for tables without lineage (in storage order). The counts are written beside the
version; their running sums name the few groups that a page touches, and within a large group counts per block of rows name the blocks. Only
those rows are read (the filters reach the Parquet scan) and put in order."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.workspace import TableMissingError, Workspace

LINEAGE = ("__source_file", "__source_sheet", "__source_row")
#: Rows of a group above which its blocks are counted; rows of a block.
LARGE_GROUP, BLOCK_ROWS = 100_000, 10_000
_COUNTS = "grp string, sub string, n long"


def _rows(ws: Workspace, ns: str, table: str) -> tuple[DataFrame, DataFrame, str]:
    """The table, the same with (grp, sub, pos) in front of its columns, and the path of its counts."""
    v = ws.current(ns, table)
    if v is None:
        raise TableMissingError(f"{TableMissingError.code}: {ns}.{table}")
    df = ws.read(ns, table)
    if set(LINEAGE) <= set(df.columns):
        place = [F.col(c) for c in LINEAGE]
    else:
        place = [F.col("_metadata.file_path"), F.lit(""), F.col("_metadata.row_index")] if v.parts else [F.lit(""), F.lit(""), F.lit(0)]
    placed = df.select(*[p.alias(n) for p, n in zip(place, ("grp", "sub", "pos"), strict=True)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
    return df, placed, os.path.join(ws._table_dir(ns, table), "_pages", f"{v.number:08d}")


def group_counts(ws: Workspace, ns: str, table: str) -> DataFrame:
    """(grp, sub, n, before) of the current version, in page order; counted by the first page that is asked for."""
    _, placed, path = _rows(ws, ns, table)
    if not ws.store.exists(f"{path}/_SUCCESS"):
        placed.groupBy("grp", "sub").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(path)
    counts = ws.spark.read.schema(_COUNTS).parquet(path)
    w = Window.orderBy("grp", "sub").rowsBetween(Window.unboundedPreceding, -1)    # a row per file and sheet
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def page(ws: Workspace, ns: str, table: str, offset: int = 0, limit: int = 100) -> tuple[DataFrame, int]:
    """Rows ``offset`` to ``offset + limit`` of the table in lineage order (or storage order), and its total row count."""
    df, placed, _ = _rows(ws, ns, table)
    counts = group_counts(ws, ns, table)
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    # at most ``limit`` groups that hold a row of the page
    hit = counts.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("grp", "sub").collect()
    if not hit or limit <= 0:
        return df.limit(0), total
    # the first and the last group may be large: only the blocks of rows that the page touches
    skip, wanted = offset - hit[0].before, F.lit(False)
    for g in hit:
        here = F.col("grp").eqNullSafe(g.grp) & F.col("sub").eqNullSafe(g.sub)
        if g.n > LARGE_GROUP:
            lo, hi = max(offset - g.before, 0), min(offset + limit - g.before, g.n)
            low, high, cut = _blocks(placed.filter(here), lo, hi)
            here = here & F.col("pos").between(low, high)
            if g is hit[0]:
                skip = lo - cut
        wanted = wanted | here
    rows = placed.filter(wanted).orderBy("grp", "sub", "pos").offset(int(skip)).limit(limit)
    return rows.select(*[F.col("r").getField(c).alias(c) for c in df.columns]), total


def _blocks(group: DataFrame, lo: int, hi: int) -> tuple[int, int, int]:
    """The first and last position of the blocks that hold rows ``lo`` to ``hi`` of a group, and the rows before them."""
    blocks = group.groupBy(F.floor(F.col("pos") / BLOCK_ROWS).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)      # a row per block of one file and sheet
    at = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter((F.col("before") < hi) & (F.col("before") + F.col("n") > lo))
    got = at.agg(F.min("b").alias("a"), F.max("b").alias("z"), F.min("before").alias("before")).first()
    return got.a * BLOCK_ROWS, got.z * BLOCK_ROWS + BLOCK_ROWS - 1, got.before
