"""The clean stage: files x rules -> one typed big table with row lineage.

R4 (per-rule mapping, union of columns), R5 (column typing), C1 (map row),
C8 (lineage columns), C10 (drill-back), G8 (run summary). One lazy plan for the
whole folder: the raw rows are materialised once in the workspace staging area
(cuts lineage, survives executor loss, each file is parsed once), header work
runs on the small header table, and the mapping is a single projection driven
by a broadcast per-(file, rule source) column-index map -- no per-file loop.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, CleanPipeline, ConfigError, Rule, validate_big_table, validate_pipeline
from ledgerloom.functions.transforms import coerce_column, coerce_parsed, numeric_text, staged_projection
from ledgerloom.operators import headers as H
from ledgerloom.operators.rules import plan_rules
from ledgerloom.plans.sizing import broadcast_if_small
from ledgerloom.plans.workspace import RunSummary, Workspace, bt_namespace
from ledgerloom.sources.csvrows import BOM_BYTES, CSV_SHEET, STAGE_OPTIONS, csv_raw_rows, literal_path
from ledgerloom.sources.files import csv_sheets, files_from_paths, list_files, match_files, relative_to, source_hit

RAW_COLUMNS = ("source_file", "source_sheet", "row_no", "cells", "kinds")
LINEAGE_COLUMNS = ("__source_file", "__source_sheet", "__source_row", "__extracted_at")
KEYS = ["source_file", "source_sheet", "header_row"]
#: The column beside a run's rows with its rejected values, and the characters of one that are kept.
REJECTS, REJECTS_TYPE, SAMPLE_CHARS = "__rejects", "array<struct<column string, value string>>", 200


@dataclass
class CleanResult:
    summary: RunSummary
    namespace: str
    table: str
    columns: list[str]
    rejects: dict[str, int] = field(default_factory=dict)
    raw_path: str | None = None          # staged raw rows, when staged
    raw_rows: DataFrame | None = None    # raw rows of the run (staged or re-scanned), for drill-back / previews
    rejected_files: DataFrame | None = None   # S11: (path, problem, skipped, n)
    rows_at: Callable[[DataFrame], DataFrame] | None = None    # CSV records by their places, where every line is one
    unused_headers: DataFrame | None = None   # H8: every header that no mapping uses
    reject_detail: DataFrame | None = None    # C7: (file, sheet, column, n, samples) of values that could not be coerced


#: Files that a run's warnings name; ``rejected_files`` has them all.
NOTED_FILES = 20
#: Unused headers that a run's summary names; ``unused_headers`` of the result has them all.
NOTED_HEADERS = 1000
REJECTED_SCHEMA = "path string, problem string, skipped boolean, n long"


def _quarantined(ws: Workspace, rejected: DataFrame | None, warnings: list[str]) -> tuple[DataFrame, int]:
    """The files with problems, staged once, with warnings for the first ones; and how many are skipped."""
    if rejected is None:
        return ws.spark.createDataFrame([], REJECTED_SCHEMA), 0
    path = ws.stage_dir("rejected")
    seen = Observation(f"rejected_{path[-12:]}")
    rejected.observe(seen, F.sum(F.col("skipped").cast("int")).alias("skipped"), F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = ws.spark.read.schema(REJECTED_SCHEMA).parquet(path)
    skipped, noted = int(seen.get["skipped"] or 0), int(seen.get["n"] or 0)
    if noted:
        for r in out.orderBy(~F.col("skipped"), "path", "problem").limit(NOTED_FILES).collect():
            name = r["path"].rsplit("/", 1)[-1]
            warnings.append(f"skipped unreadable file {name}: {r['problem']}" if r["skipped"] else f"file {name}: {r['problem']}")
    if noted > NOTED_FILES:
        warnings.append(f"{skipped} files skipped as unreadable, {noted - skipped} with other problems: see rejected_files")
    return out, skipped


def now_iso() -> str:
    return _dt.datetime.now(_dt.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def load_raw_rows(ws: Workspace, source_dir, files: DataFrame, matched: DataFrame, sources: list[tuple] | None = None,
                  exts: set[str] | None = None, max_header_row: int = 1, paths: list[str] | None = None):
    """Raw rows + sheet list for every matched source file.

    CSV lines are staged once by the scan (see ``sources/csvrows.py``); where no record spans
    lines, raw rows are expressions over them. Records assembled across lines are staged as Parquet too,
    partitioned by ``_head`` (row_no <= the largest header row of the rules) so
    the header job reads only that small partition; of workbooks only the sheets that ``sources`` (the rule
    sources; None: all sheets) want are parsed, and staged at the emitter."""
    spark = ws.spark
    ws.last_raw_path = None
    ws.last_first_rows = ws.last_rows_at = None
    # only what a rule matches is read
    exts = {r["ext"] for r in matched.select("ext").distinct().collect()} & (exts or {"csv", "xlsx", "xls"})
    parts, sheets = [], []
    info: dict = {}
    rejected = None
    if "csv" in exts:
        # the folder's files, less those that no rule source matches: the scan drops them when it lists the folder
        rel, regexes = relative_to(source_dir), None if sources is None else sorted({s[4] for s in sources})

        def keep(path: Column) -> Column:
            return F.lit(True) if regexes is None else reduce(or_, [source_hit(F.lit(x), path, rel(path)) for x in regexes], F.lit(False))
        where = source_dir if paths is None else [literal_path(p) for p in paths if p.lower().endswith(".csv")]
        csv_raw = csv_raw_rows(spark, where, info=info, max_header_row=int(max_header_row), keep=keep)
        if info.get("complex_splits", 1) > 0:
            # records spanning lines went through windows / grouping: stage them once
            stage = ws.stage_dir("raw")
            csv_raw.withColumn("_head", (F.col("row_no") <= F.lit(int(max_header_row))).cast("int")) \
                   .write.options(**STAGE_OPTIONS).partitionBy("_head").parquet(stage)
            csv_raw = spark.read.parquet(stage)
            ws.last_raw_path = stage
        else:
            csv_raw = csv_raw.withColumn("_head", (F.col("row_no") <= F.lit(int(max_header_row))).cast("int"))
        parts.append(csv_raw)
        sheets.append(csv_sheets(files))
        ws.last_first_rows, ws.last_rows_at = info.get("first_rows"), info.get("rows_at")
        # a file with bytes of which no line came
        unseen = matched.filter((F.col("ext") == "csv") & (F.col("length") > BOM_BYTES)).select("path").distinct().join(info["seen"], "path", "left_anti")
        rejected = info["notes"].unionByName(unseen.select("path", F.lit("not all bytes could be read").alias("problem"),
                                                           F.lit(True).alias("skipped"), F.lit(0).cast("long").alias("n")))
    if exts & {"xlsx", "xls"}:
        # the workbook emitter output is itself staged (each file parsed once);
        # raw rows are cheap expressions over it
        from ledgerloom.sources.workbook import MAX_WORKBOOK_BYTES, workbook_raw_rows
        raw_wb, sheets_wb, errors = workbook_raw_rows(ws, source_dir if paths is None else paths, sources, source_dir, max_header_row)
        bad = errors.select("path", F.col("error").alias("problem"), F.lit(True).alias("skipped"), F.lit(None).cast("long").alias("n"))
        large = matched.filter(F.col("ext").isin("xlsx", "xls") & (F.col("length") > MAX_WORKBOOK_BYTES)).select("path").distinct()
        bad = bad.unionByName(large.select("path", F.lit(f"a workbook of more than {MAX_WORKBOOK_BYTES} bytes").alias("problem"),
                                           F.lit(True).alias("skipped"), F.lit(None).cast("long").alias("n")))
        rejected = bad if rejected is None else rejected.unionByName(bad)
        parts.append(raw_wb)
        sheets.append(sheets_wb)
    if not parts:
        return None, None, None
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p.select(*raw.columns))
    sh = sheets[0]
    for s in sheets[1:]:
        sh = sh.unionByName(s)
    return raw, sh, rejected


def source_files(matched: DataFrame, sheets: DataFrame) -> DataFrame:
    """Pick each matched source's sheet: by name, else by index (default first)."""
    m = matched.select(F.col("path").alias("source_file"), "src_id", "rule_pos", "sheet_name",
                       "sheet_index", "header_row", "end_row")
    s = sheets.select(F.col("source_file").alias("_f"), F.col("sheet_name").alias("_sn"), "sheet_pos")
    by_name = m["sheet_name"].isNotNull() & (m["sheet_name"] != "") & (s["_sn"] == m["sheet_name"])
    by_pos = (m["sheet_name"].isNull() | (m["sheet_name"] == "")) & \
        (s["sheet_pos"] == F.coalesce(m["sheet_index"], F.lit(0)))
    j = m.join(s, (m["source_file"] == s["_f"]) & (by_name | by_pos))
    return j.select("source_file", F.col("_sn").alias("source_sheet"), "src_id", "rule_pos",
                    "header_row", "end_row")


def header_table(raw: DataFrame, src: DataFrame, broadcast_rows: int = 200_000,
                 max_header_row: int | None = None, small: bool | None = None,
                 first_rows: DataFrame | None = None) -> DataFrame:
    """Canonical headers (H1) of every (file, sheet, header row) a rule source uses.
    ``max_header_row`` (known from the rules) is pushed into the Parquet scan so
    only the first rows of each file are read."""
    keys_df = src.select(*KEYS).distinct()
    if small is None:
        keys_df = broadcast_if_small(keys_df, broadcast_rows)
    elif small:
        keys_df = F.broadcast(keys_df)
    if first_rows is not None:
        raw = first_rows                          # only the splits that hold header rows
    if "_head" in raw.columns:
        raw = raw.filter(F.col("_head") == 1)     # partition pruning: header rows only
    if max_header_row is not None:
        raw = raw.filter(F.col("row_no") <= F.lit(int(max_header_row)))
    hdr_rows = raw.join(keys_df, (raw["source_file"] == keys_df["source_file"])
                        & (raw["source_sheet"] == keys_df["source_sheet"])
                        & (raw["row_no"] == keys_df["header_row"])) \
                  .select(keys_df["source_file"], keys_df["source_sheet"], keys_df["header_row"], "cells")
    # header rows are few (files x header rows) but feed several branches of the
    # canonicalisation plan: materialised once there (reliable checkpoint)
    return H.canonicalize(H.header_long(hdr_rows, KEYS), KEYS, materialize=True)


def check_mapping(ws: Workspace, source_dir: str, rules: list[Rule]) -> DataFrame:
    """H9 (``mapping.save``): per mapped source header, NULL when it hits in at
    least one matching file, else ``duplicate`` / ``missing``. With no readable
    matching file the check is skipped (empty result)."""
    from ledgerloom.config import check_mappings
    plan = plan_rules(rules)
    for c in plan.compiled:
        check_mappings(c.mappings)
    spark = ws.spark
    files = list_files(spark, source_dir)
    matched = match_files(files, plan.sources_df(spark))
    raw, sheets, _ = load_raw_rows(ws, source_dir, files, matched, plan.sources, max_header_row=max((s[7] for s in plan.sources), default=1))
    if raw is None:
        return spark.createDataFrame([], "source_header string, problem string")
    src = source_files(matched, sheets)
    canon = header_table(raw, src)
    wanted = src.join(plan.fields_df(spark), "rule_pos").select(*KEYS, "source_header")
    return H.mapping_check(canon, wanted, KEYS)


def _cell(cells: Column, kinds: Column, idx: Column):
    value = F.get(cells, idx)
    kind = F.when(kinds.isNull(), F.lit("s")).otherwise(F.substr(kinds, idx + 1, F.lit(1)))
    return value, kind


def clean(ws: Workspace, pipeline: CleanPipeline, rules: list[Rule], big_table: BigTableConfig,
          extracted_at: str | None = None, broadcast_rows: int = 200_000,
          paths: list[str] | None = None, mode: str = "rebuild", batch: tuple[str, int] | None = None) -> CleanResult:
    """Run a clean pipeline. ``mode='rebuild'`` (M1) replaces the big table with a
    new version; ``mode='append'`` (M2) adds rows (once for each ``batch`` of a stream). ``paths`` restricts the run to
    those files of the source folder (used by the incremental stream)."""
    spark = ws.spark
    validate_pipeline(pipeline)
    validate_big_table(big_table)
    if paths is not None:
        files = files_from_paths(spark, pipeline.source_dir, paths)   # no folder listing per batch
    else:
        files = list_files(spark, pipeline.source_dir)
    files = files.cache()
    ext_counts = {r["ext"]: r["n"] for r in files.groupBy("ext").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_files = sum(ext_counts.values())
    if n_files == 0:
        raise ConfigError("CLEAN_NO_FILES", f"no source files in {pipeline.source_dir}")
    if not rules:
        raise ConfigError("CLEAN_NO_RULE", f"big table {pipeline.big_table_folder} has no rule")
    plan = plan_rules(rules)
    if not plan.columns:
        raise ConfigError("CLEAN_NO_FIELDS", f"rules for {pipeline.big_table_folder} have no included fields")
    warnings = list(plan.warnings)
    extracted_at = extracted_at or now_iso()

    matched = match_files(files, plan.sources_df(spark))
    max_header = max(s[7] for s in plan.sources) if plan.sources else 1
    raw, sheets, rejected = load_raw_rows(ws, pipeline.source_dir, files, matched, plan.sources, set(ext_counts), max_header, paths)
    rejected_files, skipped = _quarantined(ws, rejected, warnings)

    fields = plan.fields_df(spark)
    col_types = {c: big_table.type_of(c) for c in plan.columns}
    ns, table = bt_namespace(pipeline.big_table_folder), big_table.table_name

    if raw is None:
        empty = spark.createDataFrame([], ", ".join(
            [f"`{c}` {_sql_type(col_types[c])}" for c in plan.columns] +
            ["__source_file string", "__source_sheet string", "__source_row bigint", "__extracted_at string"]))
        rows, _ = ws.write_table(empty, ns, table)
        s = RunSummary(pipeline.id, "clean", True, rows, None, warnings, [], n_files, f"{ns}.{table}", skipped)
        return CleanResult(s, ns, table, plan.columns, rejected_files=rejected_files)

    src = source_files(matched, sheets).cache()
    # per-(file, rule source) tables have at most files x sources rows: that bound
    # decides broadcast vs shuffle join without counting
    small = n_files * max(1, len(plan.sources)) <= broadcast_rows
    first_rows = getattr(ws, "last_first_rows", None) if set(ext_counts) == {"csv"} else None
    canon = header_table(raw, src, broadcast_rows, max(s[7] for s in plan.sources), small, first_rows)

    wanted = src.join(fields, "rule_pos")
    cr_possible = any("\r" in f[3] for f in plan.fields)
    dups_possible = canon.filter(F.col("cnt") > 1).limit(1).count() > 0
    resolved = H.resolve(canon, wanted, KEYS, cr_possible, dups_possible).cache()
    used = src.join(plan.headers_df(spark), "rule_pos").select(*KEYS, "src_id", "source_header")
    canon_src = canon.join(src.select(*KEYS, "src_id"), KEYS)
    # one small job for all header notes: ambiguous / CR-only matches and unused headers
    notes = (resolved.filter((F.col("status") == "duplicate") | F.col("via_cr"))
                     .select("status", "source_header").distinct()
                     .unionByName(H.unused_headers(canon_src, used, KEYS + ["src_id"])
                                  .select(F.lit("unused").alias("status"), F.col("header").alias("source_header"))))
    noted = ws.stage_dir("headers")
    notes.write.parquet(noted)
    notes = spark.read.schema("status string, source_header string").parquet(noted)
    # a mapping's headers are as many as the rules name; unused ones may be any number
    mapped = notes.filter("status <> 'unused'").collect()
    if any(r["status"] == "duplicate" for r in mapped):
        H.raise_on_duplicates(resolved, canon, KEYS, "source_file")
    for r in mapped:
        warnings.append(f"source header {r['source_header']!r} matched only after ignoring carriage returns")
    all_unused = notes.filter("status = 'unused'").select("source_header")
    unused = [r["source_header"] for r in all_unused.orderBy("source_header").limit(NOTED_HEADERS).collect()]
    if unused:
        warnings.append("source headers not used by any mapping (not imported): " + ", ".join(unused))

    # one row per (file, sheet, header row, rule source): column index and
    # transform code of every output column as plain columns (no map lookups)
    ix_cols = []
    for j, c in enumerate(plan.columns):
        hit = F.col("output_name") == F.lit(c)
        ix_cols += [F.max(F.when(hit, F.col("idx"))).alias(f"_i{j}"),
                    F.max(F.when(hit, F.col("transform"))).alias(f"_t{j}")]
    ix = (src.join(resolved.select(*KEYS, "src_id", "output_name", "idx", "transform"),
                   KEYS + ["src_id"], "left")
             .groupBy(*KEYS, "src_id", "end_row").agg(*ix_cols))
    ixb = F.broadcast(ix) if small else ix
    data = raw.join(ixb, (raw["source_file"] == ixb["source_file"]) & (raw["source_sheet"] == ixb["source_sheet"])
                    & (raw["row_no"] > ixb["header_row"])
                    & (ixb["end_row"].isNull() | (raw["row_no"] <= ixb["end_row"])))

    transforms_of: dict[int, set[str]] = {}
    for (_rp, cpos, _o, _sh, tr) in plan.fields:
        transforms_of.setdefault(cpos, set()).add(tr)
    lineage = [raw["source_file"].alias("__source_file"), raw["source_sheet"].alias("__source_sheet"),
               raw["row_no"].cast("bigint").alias("__source_row"), F.lit(extracted_at).alias("__extracted_at")]
    # level 0: each output column's source cell (value, kind) and transform code;
    # then the staged transforms (every expensive intermediate computed once);
    # then typing + reject flags
    level0 = []
    for j, _c in enumerate(plan.columns):
        value, kind = _cell(raw["cells"], raw["kinds"], ixb[f"_i{j}"])
        level0 += [value.alias(f"_v{j}"), kind.alias(f"_k{j}"), ixb[f"_t{j}"].alias(f"_t{j}")]
    step0 = data.select(*level0, *lineage)
    specs = [(f"_r{j}", transforms_of.get(j, {"none"}), f"_v{j}", f"_k{j}", f"_t{j}")
             for j in range(len(plan.columns))]
    present = [(F.col(f"_v{j}").isNotNull() & (F.col(f"_v{j}") != "")).alias(f"_p{j}")
               for j in range(len(plan.columns))]
    step0 = step0.select("*", *present)
    typed_cols = [j for j, c in enumerate(plan.columns) if col_types[c] != "TEXT"]      # only these reject values
    keep_cols = list(LINEAGE_COLUMNS) + [f"_p{j}" for j in range(len(plan.columns))] + [f"_v{j}" for j in typed_cols]
    step1, cents_flags = staged_projection(step0, specs, keep_cols)
    cents_of = {j: cents_flags[f"_r{j}"] for j in range(len(plan.columns))}
    # numeric parse of text results bound for INTEGER / REAL columns, once
    parse_cols = [numeric_text(F.col(f"_r{j}")).alias(f"_n{j}") for j, c in enumerate(plan.columns)
                  if not cents_of[j] and col_types[c] == "REAL"]
    if parse_cols:
        step1 = step1.select("*", *parse_cols)
    outs, flags, details = [], [], []
    for j, c in enumerate(plan.columns):
        r = F.col(f"_r{j}")
        if not cents_of[j] and col_types[c] == "REAL":
            typed = coerce_parsed(F.col(f"_n{j}"), col_types[c])
        else:
            typed = coerce_column(r, cents_of[j], col_types[c])
        outs.append(typed.alias(c))
        pre_ok = F.col(f"_p{j}") if cents_of[j] else (r.isNotNull() & (r.cast("string") != ""))
        flags.append((pre_ok & typed.isNull()).alias(f"__rej_{j}"))
        if j in typed_cols:
            details.append(F.when(F.col(f"__rej_{j}"), F.struct(F.lit(c).alias("column"), F.left(F.col(f"_v{j}"), F.lit(SAMPLE_CHARS)).alias("value"))))
    # rejected values (present before typing, NULL after) are counted in the same
    # pass by observe; the values themselves are written beside the rows, in a column of the files that
    # is NULL in rows without rejects and not part of the table
    staged = step1.select(*outs, *LINEAGE_COLUMNS, *flags, *[f"_v{j}" for j in typed_cols])
    found = F.lit(None).cast(REJECTS_TYPE)
    if details:
        some = reduce(or_, [F.col(f"__rej_{j}") for j in typed_cols])
        found = F.when(some, F.filter(F.array(*details), lambda x: x.isNotNull()))
    metrics = [F.sum(F.col(f"__rej_{i}").cast("int")).alias(c) for i, c in enumerate(plan.columns)]
    obs_cols = [F.col(f"`{c}`") for c in plan.columns] + [F.col(c) for c in LINEAGE_COLUMNS]
    if mode == "append" and ws.exists(ns, table):
        rows, got = ws.append_observed(staged, ns, table, metrics=metrics, project=obs_cols, batch=batch, beside=found.alias(REJECTS))
    else:
        rows, got = ws.write_table(staged, ns, table, metrics=metrics, project=obs_cols, batch=batch, beside=found.alias(REJECTS))
    for kept in (files, src, resolved):
        kept.unpersist()
    detail = _reject_detail(ws, got.get("__folder"), plan.columns)
    rejects = {c: int(got.get(c) or 0) for c in plan.columns}
    for c, n in rejects.items():
        if n:
            warnings.append(f"column {c!r}: {n} value(s) could not be coerced to {col_types[c]} (stored NULL)")
    summary = RunSummary(pipeline.id, "clean", True, rows, None, warnings, unused, n_files, f"{ns}.{table}", skipped)
    ws.log_run(summary)
    return CleanResult(summary, ns, table, plan.columns, rejects, getattr(ws, "last_raw_path", None), raw,
                       rejected_files, getattr(ws, "last_rows_at", None), all_unused, detail)


def _reject_detail(ws: Workspace, folder: str | None, columns: list[str]) -> DataFrame:
    """Per file, sheet and column the rejected values' number, rows and samples (the first, the last and the smallest), from the
    column that this run's write left beside its rows; files without rejects are skipped by their statistics."""
    if folder is None:
        return ws.spark.createDataFrame([], "source_file string, source_sheet string, column string, n long, first_row long, last_row long, samples array<string>")
    schema = f"__source_file string, __source_sheet string, __source_row bigint, {REJECTS} {REJECTS_TYPE}"
    hit = ws.spark.read.schema(schema).parquet(folder).filter(F.col(REJECTS).isNotNull())
    each = hit.select(F.col("__source_file").alias("source_file"), F.col("__source_sheet").alias("source_sheet"), F.col("__source_row").alias("row"), F.explode(REJECTS).alias("r"))
    return (each.groupBy("source_file", "source_sheet", F.col("r.column").alias("column"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
                     F.array_distinct(F.array(F.min_by("r.value", "row"), F.max_by("r.value", "row"), F.min("r.value"))).alias("samples")))


def _sql_type(t: str) -> str:
    return {"INTEGER": "bigint", "REAL": "double"}.get(t, "string")


def drill_back(big: DataFrame, raw: DataFrame) -> DataFrame:
    """Join stored rows back to their source rows via the lineage columns."""
    return big.join(raw, (big["__source_file"] == raw["source_file"]) & (big["__source_sheet"] == raw["source_sheet"])
                    & (big["__source_row"] == raw["row_no"]))


#: Stored rows that ``source_rows`` looks up at a time.
MAX_PLACES = 10_000


def source_rows(result: CleanResult, big: DataFrame) -> DataFrame:
    """C10 for a page of stored rows (at most ``MAX_PLACES``; ``drill_back`` joins any number): their source rows, found by their places.
    CSV records come from the staged lines whose numbers the split index gives, all others from the staged rows of their sheets; both by filters
    that the Parquet scan skips whole files and row groups with, so the work follows the page and not the sources."""
    keys = big.select(F.col("__source_file").alias("source_file"), F.col("__source_sheet").alias("source_sheet"), F.col("__source_row").alias("row_no")).distinct()
    places = keys.limit(MAX_PLACES + 1).collect()
    if len(places) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} rows: use drill_back")
    spark = big.sparkSession
    texts = [p for p in places if p.source_sheet == CSV_SHEET and p.source_file.lower().endswith(".csv")]
    rest, parts = places, []
    if result.rows_at is not None:
        rest = [p for p in places if p not in texts]
        if texts:
            parts.append(result.rows_at(spark.createDataFrame([(p.source_file, p.row_no) for p in texts], "source_file string, row_no long")).select(*RAW_COLUMNS))
    by_sheet: dict[tuple[str, str], list[int]] = {}
    for p in rest:
        by_sheet.setdefault((p.source_file, p.source_sheet), []).append(p.row_no)
    if by_sheet:
        hit = [(F.col("source_file") == f) & (F.col("source_sheet") == s) & F.col("row_no").isin(rows) for (f, s), rows in by_sheet.items()]
        parts.append(result.raw_rows.select(*RAW_COLUMNS).filter(reduce(or_, hit)))
    return reduce(DataFrame.unionByName, parts) if parts else result.raw_rows.select(*RAW_COLUMNS).limit(0)


def duplicate_keys(ws: Workspace, cfg: BigTableConfig) -> DataFrame:
    """``primaryKey`` as a report, not a constraint: key values held by more than
    one row of the big table, with their row count (aggregated with a partial
    map-side combine; a hot key costs one counter, not a group)."""
    keys = [f.name for f in sorted(cfg.fields, key=lambda f: f.order) if f.primary_key]
    if not keys:
        raise ConfigError("BIGTABLE_NO_PRIMARY_KEY", f"{cfg.table_name}: no primaryKey field")
    df = ws.read(bt_namespace(cfg.folder), cfg.table_name)
    return (df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1))
