"""Workbook fixtures written by Spark tasks (one workbook per group of rows, which
are written as they come) from the given tables. Minimal OOXML: shared and inline strings,
numbers, booleans, error cells, an inflated dimension, missing rows, a lone
far-right cell and a header-only column -- the cases the workbook scan handles.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.suite import fixtures as FX

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"

# The orders sheet layout (title row, gap, header row 3; a last
# header with no data below it).
ORDERS_HEADER = ["订单号", "借方金额", "日期", "摘要", "状态", "标志", "错误", "备注"]
GAP_EVERY = 50
# Rows of a sheet that its dimension names at least; rows turned to XML at a time.
MAX_ROWS, ROWS_AT_ONCE = 1 << 20, 1000


def _col(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


class _Book:
    """A workbook written part by part to ``fh`` (by default in memory): a sheet's rows may be an iterator and are never held whole."""

    def __init__(self, fh=None):
        self.fh = fh if fh is not None else io.BytesIO()
        self.z = zipfile.ZipFile(self.fh, "w", zipfile.ZIP_DEFLATED)
        self.shared: list[str] = []
        self.index: dict[str, int] = {}
        self.sheets: list[str] = []

    def s(self, text: str) -> str:
        if text not in self.index:
            self.index[text] = len(self.shared)
            self.shared.append(text)
        return str(self.index[text])

    def sheet(self, name: str, dimension: str, rows: Iterable[tuple[int, list[str]]]):
        self.sheets.append(name)
        lines = iter(rows)
        with self.z.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True) as out:
            out.write((f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN}">'
                       f'<dimension ref="{dimension}"/><sheetData>').encode())
            while some := list(islice(lines, ROWS_AT_ONCE)):
                out.write("".join(f'<row r="{r}">{"".join(cells)}</row>' for r, cells in some).encode())
            out.write(b"</sheetData></worksheet>")

    def close(self) -> None:
        z = self.z
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/'
                       f'vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                       for i in range(len(self.sheets)))
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.'
                   'openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType='
                   '"application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" '
                   'ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/'
                   'vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + over +
                   '<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-'
                   'officedocument.spreadsheetml.sharedStrings+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PKG}">'
                   f'<Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/>'
                   '</Relationships>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>'
                         for i, n in enumerate(self.sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" '
                   f'xmlns:r="{RELS}"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="{RELS}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(self.sheets)))
        rels += f'<Relationship Id="rId{len(self.sheets) + 1}" Type="{RELS}/sharedStrings" Target="sharedStrings.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?>'
                   f'<Relationships xmlns="{PKG}">{rels}</Relationships>')
        sst = "".join(f"<si><t xml:space=\"preserve\">{escape(t)}</t></si>" for t in self.shared)
        z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0" encoding="UTF-8"?><sst xmlns="{MAIN}" '
                   f'count="{len(self.shared)}" uniqueCount="{len(self.shared)}">{sst}</sst>')
        z.close()

    def bytes(self) -> bytes:
        self.close()
        return self.fh.getvalue()


def _order_rows(b: _Book, orders: Iterable) -> Iterator[tuple[int, list[str]]]:
    yield 1, [f'<c r="A1" t="s"><v>{b.s("订单明细")}</v></c>', f'<c r="Z1" t="s"><v>{b.s("x")}</v></c>']
    yield 3, [f'<c r="{_col(i)}3" t="s"><v>{b.s(h)}</v></c>' for i, h in enumerate(ORDERS_HEADER)]
    last = 3
    for i, r in enumerate(orders):
        p = last = 4 + i + i // GAP_EVERY
        err = r.key % 7 == 0 and '<c r="G{p}" t="e"><v>#N/A</v></c>' or \
            (r.key % 11 == 0 and '<c r="G{p}" t="e"><v>#NULL!</v></c>' or f'<c r="G{{p}}"><v>{r.cust}</v></c>')
        yield p, [f'<c r="A{p}"><v>{r.key}</v></c>', f'<c r="B{p}"><v>{r.price!r}</v></c>',
                  f'<c r="C{p}"><v>{r.serial}</v></c>',
                  f'<c r="D{p}" t="s"><v>{b.s(r.prio + "_x000D_")}</v></c>',
                  f'<c r="E{p}" t="inlineStr"><is><t xml:space="preserve">{escape(" " + r.status + " ")}</t></is></c>',
                  f'<c r="F{p}" t="b"><v>{1 if r.status == "F" else 0}</v></c>',
                  err.format(p=p)]
    for k in range(1, 4):   # trailing rows holding only empty strings
        yield last + k, [f'<c r="A{last + k}" t="inlineStr"><is><t></t></is></c>']


def _orders_book(fh, orders: Iterable, n: int) -> None:
    """A workbook of ``n`` orders, which come in their order and are written as they come."""
    b = _Book(fh)
    b.sheet("说明", "A1:A2", [(1, [f'<c r="A1" t="s"><v>{b.s("订单导出")}</v></c>']),
                              (2, [f'<c r="A2" t="s"><v>{b.s("see orders")}</v></c>'])])
    last = 4 + n - 1 + (n - 1) // GAP_EVERY
    b.sheet("orders", f"A1:XFD{max(MAX_ROWS, last + 3)}", _order_rows(b, orders))
    b.close()


def _records(batches: Iterable[pd.DataFrame]) -> Iterator:
    for pdf in batches:
        yield from pdf.itertuples(index=False)


def orders_workbooks(spark: SparkSession, sf_dir: str, broken: tuple[str, int] | None = None) -> str:
    """orders -> one workbook per (priority, key % 4) with sheets 说明 and orders.
    ``broken=(prio, b)`` writes that one file truncated (unreadable)."""
    out = FX.fresh_dir(spark, "workbooks")
    o = FX.table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderpriority").alias("prio"), (F.col("o_orderkey") % 4).cast("int").alias("b"),
                  F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"),
                  F.datediff("o_orderdate", F.lit("1899-12-30")).alias("serial"),
                  F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    sizes = df.groupBy(F.col("prio").alias("_prio"), F.col("b").alias("_b")).agg(F.count(F.lit(1)).alias("n"))   # a row per workbook
    rows = (df.join(F.broadcast(sizes), F.col("prio").eqNullSafe(F.col("_prio")) & F.col("b").eqNullSafe(F.col("_b"))).drop("_prio", "_b")
            .repartition("prio", "b").sortWithinPartitions("prio", "b", F.asc_nulls_last("key")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (prio, bucket), orders in groupby(_records(batches), lambda r: (r.prio, int(r.b))):
            d = os.path.join(out, f"prio={prio}", f"b={bucket}")
            os.makedirs(d, exist_ok=True)
            path, first = os.path.join(d, "book.xlsx"), next(orders)
            with open(path, "wb") as fh:
                _orders_book(fh, chain([first], orders), first.n)
                if broken and (prio, bucket) == tuple(broken):
                    fh.truncate(fh.tell() // 2)
            yield pd.DataFrame({"path": [path], "rows": [first.n]})

    rows.mapInPandas(write, "path string, rows long").collect()  # file list only
    return out


def plain_workbooks(df: DataFrame, out: str, group: str, order: str) -> str:
    """One workbook of one sheet for each value of ``group``: a header row and the rows in ``order``; texts inline, numbers as they are."""
    names = [c for c in df.columns if c != group]

    def cell(ref: str, value) -> str:
        if isinstance(value, str):
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f'<c r="{ref}"><v>{value!r}</v></c>'

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        d = os.path.join(out, f"{group}={int(pdf[group].iloc[0])}")
        os.makedirs(d, exist_ok=True)
        lines = [names] + pdf.sort_values(order)[names].astype(object).values.tolist()
        b = _Book()
        b.sheet("Tabelle1", f"A1:{_col(len(names) - 1)}{len(lines)}", [(r, [cell(f"{_col(i)}{r}", v) for i, v in enumerate(line)]) for r, line in enumerate(lines, 1)])
        with open(os.path.join(d, "book.xlsx"), "wb") as fh:
            fh.write(b.bytes())
        return pd.DataFrame({"rows": [len(pdf)]})

    df.groupBy(group).applyInPandas(write, "rows long").agg(F.sum("rows")).collect()
    return out
