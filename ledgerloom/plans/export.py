"""CSV export of a query, a stored table or a source sheet.

Files are written by Spark tasks, as a folder of part files; with ``single_file=True`` the parts are written in
parallel too, without headers, and then joined in order to one file under one header. Quoting matches the reference's field
escape: NULL and '' -> empty, a field with ``" , \\n \\r`` is quoted with
doubled quotes, whitespace kept. The header is written even for empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig
from ledgerloom.functions.transforms import COLUMN_TYPES  # noqa: F401  (documented types)
from ledgerloom.plans.stages import guard_reader
from ledgerloom.plans.statements import run_sql
from ledgerloom.plans.store import Store
from ledgerloom.plans.workspace import MASTER, Workspace, bt_namespace

CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n",
    "encoding": "UTF-8",
}


def csv_field(text: str) -> str:
    """A field with a quote, comma or line break is quoted, its quotes doubled."""
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    if not single_file:
        df.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)
        return path
    store, parts = Store(df.sparkSession), f"{path}/_parts"
    df.write.mode("errorifexists").options(**CSV_OPTIONS | {"header": "false"}).csv(parts)
    store.join(f"{path}/part-00000.csv", ",".join(map(csv_field, df.columns)) + "\n", store.data_files(parts))
    store.delete(parts)
    return path


def export_query(ws: Workspace, sql: str, path: str, folder: str | None = None,
                 single_file: bool = False) -> str:
    """M5: SELECT / WITH only, against master or one big-table namespace; no row cap."""
    guard_reader(sql, ws.spark)
    df = run_sql(ws, sql, bt_namespace(folder) if folder else MASTER, [folder] if folder else [])
    return write_csv(df, path, single_file)


def export_table(ws: Workspace, cfg: BigTableConfig, path: str, include_lineage: bool = False,
                 single_file: bool = False) -> str:
    """M6: a big table without its ``__`` lineage columns (unless asked); a table
    never cleaned exports a header-only file from its configured fields."""
    ns = bt_namespace(cfg.folder)
    if ws.exists(ns, cfg.table_name):
        df = ws.read(ns, cfg.table_name)
    else:
        types = {"INTEGER": "bigint", "REAL": "double"}
        fields = sorted(cfg.fields, key=lambda f: f.order)
        schema = ", ".join(f"`{f.name}` {types.get(f.type, 'string')}" for f in fields) or "`empty` string"
        df = ws.spark.createDataFrame([], schema)
    if not include_lineage:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])
    return write_csv(df, path, single_file)


def sheet_frame(raw: DataFrame, canon: DataFrame, header_row: int = 1) -> DataFrame:
    """M7 body: one sheet's data rows as columns named by its canonical headers
    (positional). ``raw``/``canon`` must be filtered to that one sheet."""
    names = [r["name"] for r in canon.orderBy("pos").select("name").collect()]  # header cells only
    data = raw.filter(F.col("row_no") > header_row)
    return data.select("row_no", *[F.get(F.col("cells"), F.lit(i)).alias(n) for i, n in enumerate(names)])


def export_sheet(raw: DataFrame, canon: DataFrame, path: str, header_row: int = 1,
                 single_file: bool = False) -> str:
    """M7: header + rows of one source sheet, in source order."""
    df = sheet_frame(raw, canon, header_row).orderBy("row_no").drop("row_no")
    return write_csv(df, path, single_file)


def export_source_sheet(ws: Workspace, file_path: str, path: str, header_row: int = 1,
                        sheet: str | None = None, single_file: bool = False) -> str:
    """M7 entry point: header + rows of one source file's sheet (CSV: ``csv``;
    workbook: by name, else the first sheet), columns by canonical header."""
    from ledgerloom.operators import headers as H
    from ledgerloom.sources.csvrows import csv_raw_rows
    spark = ws.spark
    if file_path.lower().endswith(".csv"):
        raw = csv_raw_rows(spark, file_path)
    else:
        from ledgerloom.sources.workbook import read_workbooks, want_sheet
        raw = read_workbooks(spark, [file_path], want_sheet(sheet))
    keys = ["source_file", "source_sheet"]
    canon = H.canonicalize(H.header_long(raw.filter(F.col("row_no") == header_row), keys), keys)
    return export_sheet(raw, canon, path, header_row, single_file)
