"""S3: CSV record scan with the reference's quoting rules, as a splittable Spark job.

Semantics: UTF-8, comma separated; a ``"`` anywhere toggles quoting and ``""``
inside quotes is a literal quote; ``\\n``, ``\\r`` and ``\\r\\n`` end a record
outside quotes; blank lines are records (one empty cell); ragged rows stay
ragged; every cell stays a string. Spark's own CSV reader drops blank lines and
has no record ordinal, so records are assembled from the text source instead.

Plan (one scan of the text, no per-file task):
1. ``stage_lines``: text source with ``lineSep='\\n'`` (keeps blank lines and the
   ``\\r``) plus the split start (``_metadata.file_block_start``) and an
   in-partition ordinal. Per line: quote parity and interior ``\\r``. The lines are
   written once as Parquet: Spark may cut other splits for another job (they follow
   the settings and the executors present), so nothing after this step depends on splits.
2. ``blocks``: one row per (file, split) -- line count, odd-quote lines, first
   ordinal -- from the narrow columns of the staged lines (a hash aggregate of fixed-width
   values). A window over the splits of each file gives the quote state at each split start
   and the record offset. The table is joined back by broadcast while its size (BLOCK_BYTES a
   split) is under a bound in bytes, by shuffle otherwise. The line counts of both must agree.
3. A split that starts outside quotes and holds no odd-quote line and no lone
   ``\\r`` is *simple*: every line is one record, no window, no shuffle.
   Other splits go once through a window bounded by the split size (<=
   ``spark.sql.files.maxPartitionBytes``) that numbers the records, and are put together there, block by
   block; only the records at a block's begin and end are grouped by (file, record ordinal).
4. Fields: quote-free records use ``split``; others a JVM tokenizer
   (``regexp_extract_all``) that keeps commas inside quotes and unescapes ``""``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.sizing import broadcast_if_small
from ledgerloom.session import work_dir
from ledgerloom.sources.files import LOCK_PREFIX

CSV_SHEET = "csv"
# Field separator while quoted records are split; its own occurrences in a cell are
# escaped by _ESC before the cells are joined and restored after the split.
_SEP, _ESC = "\u0000", "\u0001"
BLOCK_BYTES = 64
BROADCAST_BYTES = 128 << 20
BOM_BYTES = 3
#: Staged text is written once and read a few times.
STAGE_OPTIONS = {"compression": "zstd"}
_TOKEN_RE = '"(?:[^"]++|"")*+"?|,|[^",]++'


def decoded_path(c):
    """``_metadata.file_path`` is URL-encoded; the file listing is not. Decode
    (keeping a literal ``+``) so both name a file the same way."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _quotes(c):
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def literal_path(p: str) -> str:
    """Escape glob characters so a file name is read as itself."""
    out = []
    for ch in p:
        if ch in "\\{}[]*?":
            out.append("\\")
        out.append(ch)
    return "".join(out)


def scan_lines(spark: SparkSession, paths, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Raw text lines of every CSV file (case-insensitive ``.csv``, ``~$`` lock files skipped) below a folder, or of the files given.
    ``keep`` is a condition on the path; files that it rejects are dropped when the scan is planned."""
    reader = (spark.read.option("lineSep", "\n")
              .option("ignoreCorruptFiles", "true")     # what is read is compared with the file's size (unreadable())
              .option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.[cC][sS][vV]"))
    paths = [paths] if isinstance(paths, str) else list(paths)
    shown = decoded_path(F.col("_metadata.file_path"))
    # the condition on the path is also tested on every line: no pattern for the name
    wanted = ~F.substring_index(shown, "/", -1).startswith(LOCK_PREFIX)
    raw = reader.text(paths).filter(wanted if keep is None else wanted & keep(shown))
    lines = raw.select(
        shown.alias("source_file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("lid"),
        F.col("value"),
    )
    # bytes that are no UTF-8 read as the replacement character
    lines = lines.withColumn("bad", (~F.is_valid_utf8(F.col("value"))).cast("int")).withColumn("raw_bytes", F.octet_length(F.col("value")))
    lines = lines.withColumn("value", F.when(F.col("bad") == 1, F.make_valid_utf8(F.col("value"))).otherwise(F.col("value")))
    trailing_cr = F.col("value").endswith("\r")
    body = F.when(trailing_cr, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return lines.select(
        "source_file", "block", "lid", "file_size",
        (F.col("raw_bytes") + 1).alias("nbytes"),
        body.alias("body"),
        trailing_cr.alias("crlf"),
        (_quotes(F.col("value")) % 2).cast("int").alias("odd"),
        F.when(F.instr(body, "\r") > 0, 1).otherwise(0).alias("lone_cr"),
        "bad",
    )


class RowCountError(RuntimeError):
    """The staged lines and their summary disagree."""
    code = "CSV_ROW_COUNT"


def stage_lines(spark: SparkSession, paths, keep: Callable[[Column], Column] | None = None) -> tuple[DataFrame, int]:
    """The scanned lines as Parquet in the shared folder (``_first`` = 1: the file's first split), and their number."""
    lines = scan_lines(spark, paths, keep).withColumn("bid", F.xxhash64("source_file", "block"))
    stage = work_dir(spark, "csv-lines", fresh=True)
    seen = Observation(f"lines_{uuid.uuid4().hex[:8]}")
    out = lines.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("_first", (F.col("block") == 0).cast("int"))
    out.write.options(**STAGE_OPTIONS).partitionBy("_first").parquet(stage)
    schema = out.schema
    return spark.read.schema(schema).parquet(stage), int(seen.get["n"] or 0)


def _block_table(lines: DataFrame) -> DataFrame:
    blocks = lines.groupBy("source_file", "block", "bid").agg(
        F.min("lid").alias("lid0"),
        F.max("lid").alias("lid_last"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("odd").alias("odd_lines"),
        F.max("lone_cr").alias("cr_lines"),
        F.sum("bad").alias("bad_lines"),
        F.sum("nbytes").alias("nbytes"),
        F.max("file_size").alias("file_size"),
    )
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_file")
    par_in = (F.coalesce(F.sum("odd_lines").over(before), F.lit(0)) % 2).cast("int")
    # every line counted with one '\n': the file size if the file ends with '\n', one more if not;
    # the reader drops a byte order mark, whose bytes are then missing
    total = F.sum("nbytes").over(whole)
    ends_nl = (total == F.col("file_size")) | (total == F.col("file_size") - BOM_BYTES)
    eof_lid = F.when(F.col("block") == F.max("block").over(whole), F.col("lid_last"))
    whole_file = (total - F.col("file_size")).isin(0, 1, -BOM_BYTES, 1 - BOM_BYTES)
    return (blocks.withColumn("par_in", par_in)
                  .withColumn("unreadable", ~whole_file)
                  .withColumn("ends_nl", ends_nl)
                  .withColumn("eof_lid", eof_lid)
                  .withColumn("simple", (F.col("par_in") == 0) & (F.col("odd_lines") == 0)
                              & (F.col("cr_lines") == 0)))


def file_notes(blocks: DataFrame) -> DataFrame:
    """(path, problem, skipped, n): a row per file and problem. A file of which not every byte could be read is skipped; one that ends
    inside quotes, or has bytes that are no UTF-8, is read as the rules say and only reported, with the number of its lines."""
    files = blocks.groupBy(F.col("source_file").alias("path")).agg(
        F.max("unreadable").alias("unreadable"), (F.sum("odd_lines") % 2).alias("open"), F.sum("bad_lines").alias("bad"), F.sum("n_lines").alias("lines"))
    problems = F.filter(F.array(
        F.when(F.col("unreadable"), F.struct(F.lit("not all bytes could be read").alias("problem"), F.lit(True).alias("skipped"), F.col("lines").alias("n"))),
        F.when(~F.col("unreadable") & (F.col("open") == 1), F.struct(F.lit("ends inside quotes").alias("problem"), F.lit(False).alias("skipped"), F.col("lines").alias("n"))),
        F.when(~F.col("unreadable") & (F.col("bad") > 0), F.struct(F.lit("bytes that are no UTF-8").alias("problem"), F.lit(False).alias("skipped"), F.col("bad").alias("n")))),
        lambda x: x.isNotNull())
    return files.select("path", F.explode(problems).alias("p")).select("path", "p.problem", "p.skipped", "p.n")


def _with_record_offsets(blocks: DataFrame, n_rec: DataFrame | None) -> DataFrame:
    if n_rec is None:
        b = blocks.withColumn("n_rec", F.col("n_lines"))
    else:
        b = (blocks.join(n_rec, ["bid", "block"], "left")
                   .withColumn("n_rec", F.when(F.col("simple"), F.col("n_lines"))
                               .otherwise(F.coalesce(F.col("n_rec_c"), F.lit(0))))
                   .drop("n_rec_c"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("recs_before", F.coalesce(F.sum("n_rec").over(before), F.lit(0)))


def _open_end(is_eof_line, ends_nl, crlf):
    """The file's last record has no terminator after it."""
    return F.coalesce(is_eof_line & ~ends_nl & ~crlf, F.lit(False))


def split_fields(text):
    """Record text -> array<string> cells with the reference's quote rules."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN_RE), 0)

    def one(t):
        q = F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))
        closed = (q % 2) == 0
        inner = F.when(closed, t.substr(F.lit(2), F.length(t) - 2)) \
                 .otherwise(t.substr(F.lit(2), F.length(t) - 1))
        return (F.when(t == ",", F.lit(_SEP))
                 .when(t.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"')))
                 .otherwise(t))

    def escaped(t):
        return F.replace(F.replace(t, F.lit(_ESC), F.lit(_ESC + "a")), F.lit(_SEP), F.lit(_ESC + "b"))

    def restored(t):
        return F.replace(F.replace(t, F.lit(_ESC + "b"), F.lit(_SEP)), F.lit(_ESC + "a"), F.lit(_ESC))

    joined = F.array_join(F.transform(tokens, one), "")
    odd_chars = (F.instr(text, _SEP) > 0) | (F.instr(text, _ESC) > 0)
    safe = F.array_join(F.transform(tokens, lambda t: F.when(t == ",", one(t)).otherwise(escaped(one(t)))), "")
    return F.when(F.instr(text, '"') == 0, F.split(text, ",", -1)) \
            .when(odd_chars, F.transform(F.split(safe, _SEP, -1), restored)) \
            .otherwise(F.split(joined, _SEP, -1))


def _joined(pieces: str, text: str) -> Column:
    """The texts of ordered pieces, with the terminators between them."""
    p = F.col(pieces)
    return F.concat(F.array_join(F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.concat(x[text], x["term"])), ""),
                    F.element_at(p, -1)[text])


def csv_records(spark: SparkSession, paths, broadcast_bytes: int = BROADCAST_BYTES, info: dict | None = None,
                max_header_row: int = 1, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(source_file, row_no, text, open_end)``: one row per CSV record; ``row_no`` is the
    1-based record ordinal within its file (blank records counted)."""
    lines, n_lines = stage_lines(spark, paths, keep)
    blocks = _block_table(lines).checkpoint(eager=True)
    totals = [F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("lines"),
              F.sum(F.when(F.col("simple"), 0).otherwise(1)).alias("complex"),
              # files whose first split may not hold all header rows
              F.sum(F.when((F.col("block") == 0) & (F.col("n_lines") < max_header_row) & F.col("eof_lid").isNull(), 1)
                    .otherwise(0)).alias("late"),
              F.sum(F.col("unreadable").cast("int")).alias("unreadable")]
    stats = blocks.agg(*totals).first()
    if int(stats["lines"] or 0) != n_lines:
        raise RowCountError(f"{RowCountError.code}: {n_lines} lines staged, {stats['lines']} summarised")
    if info is not None:
        info["notes"], info["seen"] = file_notes(blocks), blocks.select(F.col("source_file").alias("path")).distinct()
    if int(stats["unreadable"] or 0):
        blocks = blocks.filter(~F.col("unreadable"))
        kept = blocks.select("bid", "block")
        lines = lines.join(broadcast_if_small(kept, BROADCAST_BYTES // BLOCK_BYTES), ["bid", "block"], "left_semi")
        stats = blocks.agg(*totals).first()
    n_complex = int(stats["complex"] or 0)
    small = int(stats["n"]) * BLOCK_BYTES <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    if info is not None:
        info.update(splits=int(stats["n"]), complex_splits=n_complex)

    def simple_records(rows: DataFrame, offsets: DataFrame) -> DataFrame:
        return (rows.join(hint(offsets.select("bid", "block", "lid0", "recs_before", "ends_nl", "eof_lid")), ["bid", "block"])
                    .select("source_file",
                            (F.col("recs_before") + F.col("lid") - F.col("lid0") + 1).alias("row_no"),
                            F.col("body").alias("text"),
                            _open_end(F.col("lid") == F.col("eof_lid"), F.col("ends_nl"), F.col("crlf")).alias("open_end")))

    if n_complex == 0:
        offsets = _with_record_offsets(blocks, None)
        if info is not None:
            head = lines if int(stats["late"] or 0) else lines.filter("_first = 1")
            info["first_records"] = simple_records(head, offsets)
            # single records by the staged lines that hold them, which the Parquet scan finds by their numbers
            info["offsets"] = offsets
            info["records_at"] = lambda lids: simple_records(lines.filter(F.col("lid").isin(lids)), offsets)
        return simple_records(lines, offsets)

    flags = hint(blocks.filter(~F.col("simple")).select("bid", "block", "par_in", "ends_nl", "eof_lid"))
    # complex splits: one row per \r-separated segment, with its terminator
    seg = (lines.join(flags, ["bid", "block"])
                .select("source_file", "bid", "block", "lid", "par_in", "crlf", "ends_nl", "eof_lid",
                        F.posexplode(F.split(F.col("body"), "\r", -1)).alias("sub", "seg"),
                        F.size(F.split(F.col("body"), "\r", -1)).alias("n_sub")))
    at_eof = (F.col("lid") == F.col("eof_lid")) & (F.col("sub") == F.col("n_sub") - 1)
    seg = seg.withColumn("term", F.when(F.col("sub") < F.col("n_sub") - 1, F.lit("\r"))
                                  .when(at_eof & ~F.col("ends_nl"), F.when(F.col("crlf"), F.lit("\r")).otherwise(F.lit("")))
                                  .when(F.col("crlf"), F.lit("\r\n")).otherwise(F.lit("\n")))
    w = Window.partitionBy("bid", "block").orderBy("lid", "sub")
    seg = seg.withColumn("odd_seg", (_quotes(F.col("seg")) % 2).cast("int"))
    par_start = (F.col("par_in") + F.coalesce(
        F.sum("odd_seg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2
    seg = seg.withColumn("is_start", (par_start == 0).cast("int"))
    seg = seg.withColumn("rec_in_block", F.sum("is_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a block's part of each record, put together where the window left its lines: no further shuffle of the text
    pieces = (seg.groupBy("source_file", "bid", "block", "rec_in_block")
                 .agg(F.sort_array(F.collect_list(F.struct("lid", "sub", "seg", "term"))).alias("p"), F.sum("odd_seg").alias("odd")))
    pieces = pieces.select("source_file", "bid", "block", "rec_in_block", "odd", _joined("p", "seg").alias("text"), F.element_at("p", -1)["term"].alias("term"))
    stage = work_dir(spark, "csv-records", fresh=True)     # the window runs once
    pieces.write.options(**STAGE_OPTIONS).parquet(stage)
    pieces = spark.read.schema(pieces.schema).parquet(stage)

    n_rec = pieces.groupBy("bid", "block").agg(F.max("rec_in_block").alias("n_rec_c"))
    offsets = _with_record_offsets(blocks, n_rec).checkpoint(eager=True)
    simple_recs = simple_records(lines, offsets.filter("simple"))
    numbered = (pieces.join(hint(offsets.select("bid", "block", "recs_before", "n_rec")), ["bid", "block"])
                      .withColumn("row_no", F.col("recs_before") + F.col("rec_in_block")))
    # all but the records at a block's begin and end lie in their block as a whole
    inner = (F.col("rec_in_block") > 0) & (F.col("rec_in_block") < F.col("n_rec"))
    whole_recs = numbered.filter(inner).select("source_file", "row_no", "text", (F.col("term") == "").alias("open_end"))
    parts = (numbered.filter(~inner).groupBy("source_file", "row_no")
                     .agg(F.sort_array(F.collect_list(F.struct("block", "text", "term"))).alias("p"), F.sum("odd").alias("odd")))
    last = F.element_at(F.col("p"), -1)
    # a record still inside quotes at the end of the file keeps its last
    # terminator characters as content
    unterminated = (F.col("odd") % 2) == 1
    text = F.concat(_joined("p", "text"), F.when(unterminated, last["term"]).otherwise(F.lit("")))
    spanning = parts.select("source_file", "row_no", text.alias("text"),
                            (unterminated | (last["term"] == "")).alias("open_end"))
    return simple_recs.unionByName(whole_recs).unionByName(spanning)


def _cells(recs: DataFrame) -> DataFrame:
    # a last record with no terminator and no content is not a record; told by the text (these are all that
    # split into one empty cell), so that the test needs no cells
    recs = recs.filter(~(F.col("open_end") & F.col("text").isin("", '"', '""'))).withColumn("cells", split_fields(F.col("text")))
    return recs.select(
        "source_file",
        F.lit(CSV_SHEET).alias("source_sheet"),
        F.col("row_no").cast("long").alias("row_no"),
        F.col("cells"),
        F.lit(None).cast("string").alias("kinds"),
    )


def csv_raw_rows(spark: SparkSession, paths, broadcast_bytes: int = BROADCAST_BYTES, info: dict | None = None,
                 max_header_row: int = 1, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``raw_rows`` for CSV: (source_file, source_sheet='csv', row_no, cells, kinds=NULL).
    ``info`` (optional dict) receives the split counts (``complex_splits`` = splits
    that needed the record-assembly path) and, without such splits, ``first_rows``: the raw
    rows of the splits that hold the rows up to ``max_header_row``."""
    recs = csv_records(spark, paths, broadcast_bytes, info, max_header_row, keep)
    if info is not None and "first_records" in info:
        info["first_rows"] = _cells(info.pop("first_records"))
        at = info.pop("records_at")
        info["rows_at"] = lambda keys: _cells(at(_line_numbers(info["offsets"], keys)))
    return _cells(recs)


def _line_numbers(offsets: DataFrame, keys: DataFrame) -> list[int]:
    """The numbers of the staged lines that hold the records ``keys`` (source_file, row_no; a page of them): a split
    holds its records one a line, from ``recs_before`` on."""
    k = keys.select(F.col("source_file").alias("f"), F.col("row_no").alias("r")).distinct()
    hit = offsets.join(F.broadcast(k), (F.col("source_file") == F.col("f")) & (F.col("r") > F.col("recs_before")) & (F.col("r") <= F.col("recs_before") + F.col("n_rec")))
    return [r.lid for r in hit.select((F.col("lid0") + F.col("r") - F.col("recs_before") - 1).alias("lid")).collect()]
