"""S4 workbook scan (+ S5 sheet listing, S6 bounds, S7 gap fill, S9 cell typing,
S10 ``_xHHHH_`` decoding, S11 quarantine).

The only Python on the data path: a workbook is a zip of XML parts and cannot
be split, so each file is one task's. Spark's reader gives ``binaryFile`` rows, one file per
Arrow batch (files that no rule source matches are pruned when the scan is planned, by their path), and
``mapInPandas`` lists every sheet from the zip directory and ``workbook.xml``, and parses the XML of the
wanted sheets only: a rule source says which sheet of a file, and up to which row. The XML is streamed with
``iterparse``, yielding Arrow batches of at most ``BATCH_ROWS`` rows
-- memory stays flat however long the sheet is. The emitter only decodes cells
into the tagged (value, kind) form plus a few per-sheet counters; everything
after (bounds rule, gap rows, column cut, trailing-empty trim, sheet choice,
quarantine of partial files) is DataFrame expressions and joins.

A workbook of more than ``MAX_WORKBOOK_BYTES`` does not fit in a row: Spark's text reader gives its bytes cut at a
separator, which are shuffled to one task and put together in a temporary file there. Clean skips such files and reports them (S11).

Emitted records (one schema, ``rec`` tells them apart):
  ``listed`` every sheet of a file with its position, parsed or not.
  ``row``   every physical row of a wanted sheet from the dimension start to the last ``<row>``
            (missing rows become empty rows -- S7 gap fill), cells relative to
            the dimension's first column; holes are ''.
  ``sheet`` per parsed sheet: position, dimension size, last row holding a value, and
            the number of values in each column (S6 inputs).
  ``error`` a file that could not be read (S11); its rows are dropped.
"""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.sizing import broadcast_if_small
from ledgerloom.session import clone, work_dir
from ledgerloom.sources.csvrows import decoded_path, literal_path
from ledgerloom.sources.files import LOCK_PREFIX, WORKBOOK_EXT_RE, relative_to, source_hit

BATCH_ROWS = 5000
#: Larger workbooks come in pieces: Spark's rows hold at most 2 GB.
MAX_WORKBOOK_BYTES = 2**31 - 2**20
#: The byte that cuts them, frequent in packed and in plain XML, and the size of a piece.
CUT, PIECE_BYTES = b"<", 1 << 20
NS_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
NS_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Spreadsheet error texts and their numeric codes (code 0 reads as
# NULL, every other known error as '').
ERROR_CODES = {"#NULL!": 0, "#DIV/0!": 7, "#VALUE!": 15, "#REF!": 23, "#NAME?": 29, "#NUM!": 36,
               "#N/A": 42, "#GETTING_DATA": 43, "#WTF?": 255}

EMIT_COLUMNS = ("rec", "source_file", "source_sheet", "sheet_pos", "row_no", "cells", "kinds", "dim_rows", "dim_cols",
                "max_value_row", "col_counts", "error")
EMIT_SCHEMA = ("rec string, source_file string, source_sheet string, sheet_pos int, row_no long, "
               "cells array<string>, kinds string, dim_rows long, dim_cols int, max_value_row long, "
               "col_counts array<long>, error string")

_ESC = re.compile(r"_x([0-9A-Fa-f]{4})_")
_REF = re.compile(r"^([A-Z]+)([0-9]+)$")


def decode_escapes(s: str) -> str:
    """``_xHHHH_`` -> the code point, one left-to-right pass (``_x005F_``
    protects a literal escape)."""
    return _ESC.sub(lambda m: chr(int(m.group(1), 16)), s) if "_x" in s else s


def col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def number_text(raw: str) -> str:
    """A numeric cell as the shortest decimal text (integral values without a
    fraction; exponents as ``1e-7`` / ``1e+21``)."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    if x != x or x in (float("inf"), float("-inf")):
        return raw
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    r = repr(x)
    if "e" in r:
        if 1e-7 <= abs(x) < 1e21:
            import numpy as np
            return np.format_float_positional(x, trim="-")
        mant, exp = r.split("e")
        sign = "-" if exp.startswith("-") else "+"
        return f"{mant}e{sign}{exp.lstrip('+-').lstrip('0') or '0'}"
    return r


def _text_of(el) -> str:
    """Concatenated ``<t>`` text of a shared / inline string (rich-text runs too)."""
    return "".join(t.text or "" for t in el.iter(f"{NS_MAIN}t"))


def _parts(z: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """The parts of a package by name; some writers separate folders by backslashes."""
    return {i.filename.replace("\\", "/"): i for i in z.infolist()}


def _sheet_targets(z: zipfile.ZipFile, parts: dict[str, zipfile.ZipInfo]) -> list[tuple[str, str]]:
    """(name, part) of every sheet in order. Targets are relative to ``xl/`` or start at the package; a sheet without a
    relation has the part of its number."""
    rels = {}
    if "xl/_rels/workbook.xml.rels" in parts:
        with z.open(parts["xl/_rels/workbook.xml.rels"]) as fh:
            for _, el in iterparse(fh):
                if el.tag.endswith("Relationship"):
                    rels[el.get("Id")] = el.get("Target")
    out = []
    with z.open(parts["xl/workbook.xml"]) as fh:
        for _, el in iterparse(fh):
            if el.tag == f"{NS_MAIN}sheet":
                target = (rels.get(el.get(f"{NS_REL}id")) or f"worksheets/sheet{len(out) + 1}.xml").replace("\\", "/").lstrip("/")
                out.append((el.get("name") or "", target if target.startswith("xl/") else "xl/" + target))
    return out


def _shared_strings(z: zipfile.ZipFile, parts: dict[str, zipfile.ZipInfo]) -> list[str]:
    if "xl/sharedStrings.xml" not in parts:
        return []
    out = []
    with z.open(parts["xl/sharedStrings.xml"]) as fh:
        for _, el in iterparse(fh):
            if el.tag == f"{NS_MAIN}si":
                out.append(decode_escapes(_text_of(el)))
                el.clear()
    return out


def _wanted(sheets: list[tuple[str, str]], wants) -> dict[int, int | None]:
    """Positions of the wanted sheets and the last row wanted of each (None: all). A want names a sheet, or gives its position;
    with ``fallback`` a name that is not there means the first sheet."""
    if wants is None:
        return {pos: None for pos in range(len(sheets))}
    out: dict[int, int | None] = {}
    names = [n for n, _ in sheets]
    for w in wants:
        pos = w["pos"] if w["name"] is None else names.index(w["name"]) if w["name"] in names else 0 if w["fallback"] else None
        if pos is None or not 0 <= pos < len(sheets):
            continue
        last = None if w["last"] is None else int(w["last"])
        out[pos] = None if last is None or out.get(pos, 0) is None else max(last, out.get(pos, 0))
    return out


def cell_value(t: str | None, raw: str | None, inline: str | None, shared: list[str]) -> tuple[str | None, str, bool]:
    """(value, kind, counts_as_value). Booleans read true for 1/true/TRUE;
    known errors keep kind ``e`` (code 0 -> NULL, others ''), unknown errors are
    plain ''; numbers become their shortest text; empty -> ''."""
    if t == "inlineStr":
        v = decode_escapes(inline or "")
        return v, "s", v != ""
    if t == "s":
        i = int(raw) if raw not in (None, "") else -1
        v = shared[i] if 0 <= i < len(shared) else ""     # an index out of range is an empty cell
        return v, "s", v != ""
    if t == "str":
        v = decode_escapes(raw or "")
        return v, "s", v != ""
    if t == "b":
        return ("true" if raw in ("1", "true", "TRUE") else "false"), "b", True
    if t == "e":
        if raw in ERROR_CODES:
            return (None if ERROR_CODES[raw] == 0 else ""), "e", True
        return "", "s", False
    if raw in (None, ""):
        return "", "s", False
    return number_text(raw), "n", True


def _rows_frame(path, sheet, pos, buf):
    return pd.DataFrame({
        "rec": "row", "source_file": path, "source_sheet": sheet, "sheet_pos": pos,
        "row_no": [b[0] for b in buf], "cells": [b[1] for b in buf], "kinds": [b[2] for b in buf],
        "dim_rows": None, "dim_cols": None, "max_value_row": None, "col_counts": None, "error": None})


def _record(**values) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(EMIT_COLUMNS) | values])


def _emit_file(path: str, content: BinaryIO, wants=None) -> Iterator[pd.DataFrame]:
    z = zipfile.ZipFile(content)
    parts = _parts(z)
    sheets = _sheet_targets(z, parts)
    for pos, (name, _) in enumerate(sheets):
        yield _record(rec="listed", source_file=path, source_sheet=name, sheet_pos=pos)
    wanted = {p: last for p, last in _wanted(sheets, wants).items() if sheets[p][1] in parts}
    shared = _shared_strings(z, parts) if wanted else []
    tag_c, tag_v, tag_is = f"{NS_MAIN}c", f"{NS_MAIN}v", f"{NS_MAIN}is"
    col_cache: dict[str, int] = {}
    for pos, until in wanted.items():
        name, target = sheets[pos]
        row0 = col0 = 0
        dim_rows = dim_cols = None
        counts: dict[int, int] = {}
        max_value_row = 0
        next_row = None          # next physical row (0-based) to emit
        buf, rows = [], None
        with z.open(parts[target]) as fh:
            for ev, el in iterparse(fh, events=("start", "end")):
                tag = el.tag
                if ev == "start":
                    rows = el if tag == f"{NS_MAIN}sheetData" else rows
                elif tag == f"{NS_MAIN}dimension":
                    ref = el.get("ref", "A1")
                    a, _, b = ref.partition(":")
                    ma, mb = _REF.match(a), _REF.match(b or a)
                    if ma and mb:
                        row0, col0 = int(ma.group(2)) - 1, col_index(ma.group(1))
                        dim_rows = int(mb.group(2)) - row0
                        dim_cols = col_index(mb.group(1)) - col0 + 1
                elif tag == f"{NS_MAIN}row":
                    r = int(el.get("r")) - 1 if el.get("r") else (next_row if next_row is not None else row0)
                    if next_row is None:
                        next_row = row0
                    cells, kinds, valued = [], [], False
                    auto_c = 0
                    for c in el:
                        if c.tag != tag_c:
                            continue
                        ref = c.get("r")
                        if ref:
                            letters = ref.rstrip("0123456789")
                            ci = col_cache.get(letters)
                            if ci is None:
                                ci = col_cache[letters] = col_index(letters)
                        else:
                            ci = auto_c
                        auto_c = ci + 1
                        rel = ci - col0
                        if rel < 0:
                            continue
                        v_text = inline = None
                        for ch in c:
                            if ch.tag == tag_v:
                                v_text = ch.text
                            elif ch.tag == tag_is:
                                inline = _text_of(ch)
                        val, kind, counted = cell_value(c.get("t"), v_text, inline, shared)
                        if len(cells) < rel:
                            pad = rel - len(cells)
                            cells.extend([""] * pad)
                            kinds.extend(["s"] * pad)
                        cells.append(val)
                        kinds.append(kind)
                        if counted:
                            counts[rel] = counts.get(rel, 0) + 1
                            max_value_row = max(max_value_row, r - row0 + 1)
                            valued = True
                    if valued:
                        # Missing and empty rows are written once a row with a value follows
                        # (a sheet's trailing empty rows are cut anyway, S6)
                        while next_row < r and (until is None or next_row - row0 < until):
                            buf.append((next_row - row0 + 1, [], ""))
                            next_row += 1
                            if len(buf) >= BATCH_ROWS:
                                yield _rows_frame(path, name, pos, buf)
                                buf = []
                        if r >= row0 and (until is None or r - row0 < until):
                            buf.append((r - row0 + 1, cells, "".join(kinds)))
                        next_row = r + 1
                    if rows is not None:
                        rows.clear()                         # cleared rows must not pile up under their parent
                    if len(buf) >= BATCH_ROWS:
                        yield _rows_frame(path, name, pos, buf)
                        buf = []
        if buf:
            yield _rows_frame(path, name, pos, buf)
        n_cols = max(counts) + 1 if counts else 0
        yield _record(rec="sheet", source_file=path, source_sheet=name, sheet_pos=pos,
                      dim_rows=dim_rows if dim_rows is not None else max_value_row, dim_cols=dim_cols if dim_cols is not None else n_cols,
                      max_value_row=max_value_row, col_counts=[counts.get(i, 0) for i in range(n_cols)])


def _emit_or_report(path: str, content: BinaryIO, wants) -> Iterator[pd.DataFrame]:
    try:
        yield from _emit_file(path, content, wants)
    except Exception as e:  # noqa: BLE001 - S11: quarantine, never fail the run
        yield _record(rec="error", source_file=path, error=f"{type(e).__name__}: {e}")


def _emitter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content, wants in zip(pdf["path"], pdf["content"], pdf["wants"]):
            yield from _emit_or_report(path, io.BytesIO(content), wants)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each file split, which come cut at CUT and in order, as numbered pieces."""
    at, part, held, n = None, 0, [], 0

    def piece() -> pd.DataFrame:
        return pd.DataFrame({"path": [at[0]], "size": [at[1]], "start": [at[2]], "part": [part], "piece": [CUT.join([*held, b""])]})
    for pdf in batches:
        for path, size, start, value in zip(pdf["path"], pdf["size"], pdf["start"], pdf["value"]):
            if held and ((path, size, start) != at or n >= PIECE_BYTES):
                yield piece()
                part, held, n = part + 1, [], 0
            at = (path, size, start)
            held.append(value)
            n += len(value) + 1
    if held:
        yield piece()


def _piece_emitter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of workbooks whose pieces come file by file, in order."""
    def records() -> Iterator[pd.DataFrame]:
        if fh.tell() - size not in (0, 1):  # the last piece ends with a CUT that the file may not have
            yield _record(rec="error", source_file=at, error="not all bytes could be read")
            return
        fh.truncate(size)
        yield from _emit_or_report(at, fh, wants)
    at = fh = None
    try:
        for pdf in batches:
            for path, n, piece, w in zip(pdf["path"], pdf["size"], pdf["piece"], pdf["wants"]):
                if path != at:
                    if fh is not None:
                        yield from records()
                        fh.close()
                    at, size, wants, fh = path, n, w, tempfile.TemporaryFile()
                fh.write(piece)
        if fh is not None:
            yield from records()
    finally:
        if fh is not None:
            fh.close()


WANTS = "array<struct<name string, pos int, last long, fallback boolean>>"
# One workbook per Arrow batch; small ones share a task (a task each costs more than reading them), larger ones have their own:
# files are read where they are, no bytes are shuffled.
_ONE_FILE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.files.maxPartitionBytes": str(1 << 20),
             "spark.sql.files.openCostInBytes": str(1 << 14)}
# Lines and pieces are batched by their bytes.
_PIECES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


def wants_of(sources: list[tuple], path: Column, rel_path: Column) -> Column:
    """What the rule sources (rows of ``SOURCES_SCHEMA``; bounded by the rules) want of the file at ``path``: an empty array
    if none matches it. A source wants a sheet by name, else by position (the first), up to its last row."""
    hits = []
    for _, _, _, _, regex, name, index, header_row, end_row in sources:
        last = None if end_row is None else max(int(end_row), int(header_row))
        want = F.struct(F.lit(name or None).cast("string").alias("name"), F.lit(index or 0).alias("pos"), F.lit(last).cast("long").alias("last"),
                        F.lit(False).alias("fallback"))
        hits.append(F.when(source_hit(F.lit(regex), path, rel_path), want))
    return F.filter(F.array(*hits), lambda w: w.isNotNull()).cast(WANTS) if hits else F.array().cast(WANTS)


def want_sheet(name: str | None = None, last: int | None = None, fallback: bool = False) -> Column:
    """One sheet of every file: by name (with ``fallback`` the first if the name is not there), else the first."""
    return F.array(F.struct(F.lit(name or None).cast("string").alias("name"), F.lit(0).alias("pos"), F.lit(last).cast("long").alias("last"),
                            F.lit(fallback).alias("fallback")))


def _workbooks(spark: SparkSession, root: str | list[str], kind: str, conf: dict[str, str], size: Callable[[Column], Column],
               prune: Callable[[Column], Column] | None = None, **options: str) -> tuple[DataFrame, Column]:
    """The workbooks below a folder, or those given, whose size meets a condition, in the format ``kind`` and a session of its own;
    and the column of their paths. ``prune`` is a condition on the path; all are applied when the files are listed."""
    own = clone(spark)
    for k, v in conf.items():
        own.conf.set(k, v)
    reader = own.read.format(kind).options(recursiveFileLookup="true", **options)
    src = reader.load([literal_path(p) for p in root] if isinstance(root, list) else root)
    shown = decoded_path(F.col("_metadata.file_path"))
    name = F.regexp_extract(shown, "([^/]*)$", 1)
    keep = name.rlike(WORKBOOK_EXT_RE) & ~name.startswith(LOCK_PREFIX) & size(F.col("_metadata.file_size"))
    return src.filter(keep if prune is None else keep & prune(shown)), shown


def _scan(spark: SparkSession, root: str | list[str], prune: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, content) of the workbooks that fit in a row, one file at a time."""
    return _workbooks(spark, root, "binaryFile", _ONE_FILE, lambda n: n <= MAX_WORKBOOK_BYTES, prune)[0].select("path", "content")


def _scan_pieces(spark: SparkSession, root: str | list[str]) -> DataFrame | None:
    """(path, size, start, part, piece) of the larger workbooks, each file in one task and in order; None if there is none."""
    def large(kind: str, conf: dict[str, str], **options: str) -> tuple[DataFrame, Column]:
        return _workbooks(spark, root, kind, conf, lambda n: n > MAX_WORKBOOK_BYTES, **options)
    if large("binaryFile", _ONE_FILE)[0].select("path").isEmpty():
        return None
    # the text reader keeps all bytes and, unlike the binary one, splits a file
    lines, path = large("text", _PIECES, lineSep=CUT.decode())
    lines = lines.select(path.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary"))
    pieces = lines.mapInPandas(_pieces, "path string, size long, start long, part long, piece binary")
    return pieces.repartition("path").sortWithinPartitions("path", "start", "part")


def emit(scan: DataFrame, wants: Column, stage: str, max_header_row: int = 1, emitter: Callable = _emitter, mode: str = "errorifexists") -> None:
    """The emitter's records of a scan, written once as Parquet (each workbook parsed once) and partitioned by ``_head``:
    sheet / error records and rows up to the largest header row in 1, so header extraction and sheet listing read only that."""
    out = scan.withColumn("wants", wants).mapInPandas(emitter, EMIT_SCHEMA).withColumn("_head", F.when(
        (F.col("rec") != "row") | (F.col("row_no") <= F.lit(int(max_header_row))), F.lit(1)).otherwise(F.lit(0)))
    out.write.mode(mode).partitionBy("_head").parquet(stage)


def emit_workbooks(spark: SparkSession, root: str | list[str], stage: str | None = None, max_header_row: int = 1,
                   sources: list[tuple] | None = None, wants: Column | None = None, base: str | None = None) -> DataFrame:
    """The emitter's records of the workbooks below a folder or of the files given. ``sources``: only files that
    a rule source matches (relative to ``base``) and that fit in a row (clean reports the others), and only the sheets they want;
    ``wants``: the same sheets of every file; else all."""
    stage = stage or work_dir(spark, "workbooks", fresh=True)
    if sources is not None:
        rel = relative_to(base or root)
        scan = _scan(spark, root, lambda p: F.size(wants_of(sources, p, rel(p))) > 0)
        emit(scan, wants_of(sources, F.col("path"), rel(F.col("path"))), stage, max_header_row)
    else:
        same = (F.lit(None) if wants is None else wants).cast(WANTS)
        emit(_scan(spark, root), same, stage, max_header_row)
        large = _scan_pieces(spark, root)
        if large is not None:
            emit(large, same, stage, max_header_row, _piece_emitter, "append")
    return spark.read.schema(EMIT_SCHEMA + ", _head int").parquet(stage)


def workbook_sheets(spark: SparkSession, root: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(source_file, sheet_name, sheet_pos) of every workbook, and the files that cannot be read; no sheet is parsed."""
    return sheet_list(emit_workbooks(spark, root, wants=F.array().cast(WANTS)))


def sheet_list(emitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed sheets of readable files, and (path, error) of the others."""
    meta = emitted.filter(F.col("_head") == 1)
    errors = meta.filter(F.col("rec") == "error").select(F.col("source_file").alias("path"), "error")
    listed = meta.filter(F.col("rec") == "listed").join(errors.select(F.col("path").alias("source_file")), "source_file", "left_anti")
    return listed.select("source_file", F.col("source_sheet").alias("sheet_name"), "sheet_pos"), errors


def sheet_bounds(sheets: DataFrame) -> DataFrame:
    """S6 on the per-sheet counters: (file, sheet, pos, row_end, n_cols)."""
    cols2 = F.filter(F.transform("col_counts", lambda c, i: F.when(c >= 2, i)), lambda x: x.isNotNull())
    real_col = F.coalesce(F.array_max(cols2), F.col("dim_cols") - 1)
    return sheets.select(
        "source_file", "source_sheet", "sheet_pos",
        F.least(F.col("dim_rows"), F.col("max_value_row")).alias("row_end"),
        F.greatest(F.least(F.col("dim_cols") - 1, real_col) + 1, F.lit(0)).alias("n_cols"))


def shape_rows(emitted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S6 bounds + column cut + trailing-empty trim (S7) as DataFrame expressions.

    Returns (raw_rows, sheets, rejected). Row end = last row holding a value
    (capped by the dimension); column end = rightmost column with at least two
    values (a lone value is formatting debris), else the declared width."""
    listed, errors = sheet_list(emitted)
    bounds = sheet_bounds(emitted.filter((F.col("_head") == 1) & (F.col("rec") == "sheet")))
    rows = emitted.filter(F.col("rec") == "row").join(broadcast_if_small(bounds, 200_000),
                                                      ["source_file", "source_sheet", "sheet_pos"])
    rows = rows.filter(F.col("row_no") <= F.col("row_end"))
    cut = F.slice("cells", 1, F.greatest(F.col("n_cols"), F.lit(0)))
    last = F.aggregate(F.transform(cut, lambda x, i: F.when(x.isNotNull() & (x != ""), i + 1).otherwise(0)),
                       F.lit(0), lambda a, b: F.greatest(a, b))
    raw = rows.select("source_file", "source_sheet", "sheet_pos", "row_no",
                      F.slice(cut, 1, last).alias("cells"), F.substring("kinds", 1, last).alias("kinds"), "_head")
    raw = raw.join(errors.select(F.col("path").alias("source_file")), "source_file", "left_anti")
    return raw, listed, errors


def read_workbooks(spark: SparkSession, paths: list[str], wants: Column | None = None) -> DataFrame:
    """Raw rows (with ``sheet_pos``) of the given workbook files, of the wanted sheets (all by default)."""
    raw, _, _ = shape_rows(emit_workbooks(spark, paths, wants=wants))
    return raw.drop("_head")


def workbook_raw_rows(ws, root: str | list[str], sources: list[tuple] | None, base: str, max_header_row: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Emitter output staged once as Parquet (each workbook parsed once, wanted sheets only), then
    shaped: (raw_rows without sheet_pos, sheets, rejected files)."""
    raw, sheets, errors = shape_rows(emit_workbooks(ws.spark, root, ws.stage_dir("workbooks"), max_header_row, sources, base=base))
    return raw.drop("sheet_pos"), sheets, errors
