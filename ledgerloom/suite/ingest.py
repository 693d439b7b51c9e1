"""File-based checks: sources, rules, transforms, lineage and the three stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, BigTableField, QueryPipeline, Rule, RuleField, RuleSource, SqlCleanPipeline
from ledgerloom.plans.stages import run_query, sql_clean
from ledgerloom.suite import fixtures as FX
from ledgerloom.suite.common import clean_folder, path_part, sql_cents

ORACLES: dict[str, str] = {}

# The journal rule (source headers as in the fixture folder).
JOURNAL_RULE = Rule("journal", [RuleSource("**/*.csv", 1)], [
    RuleField("订单号", "order_key", 0, True, ["none"]),
    RuleField("借方金额", "fen", 1, True, ["coerce_cents"]),
    RuleField("日期", "date", 2, True, ["coerce_date"]),
    RuleField("摘要", "note", 3, True, ["coerce_string"]),
])
JOURNAL_TABLE = BigTableConfig("门店账", "entries", [BigTableField("order_key", "INTEGER"),
                                                 BigTableField("fen", "INTEGER")])
# amounts by the number of digits of their cents
BUCKET_SQL = """SELECT LENGTH(CAST(fen AS STRING)) AS digits, COUNT(*) AS n, SUM(fen) AS total, MAX("date") AS last_day
FROM entries WHERE fen > 0 GROUP BY LENGTH(CAST(fen AS STRING))"""


def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: journal CSV folder -> clean -> sql-clean into master -> sizes of the amounts by their digits."""
    folder = FX.journal_folder(spark, sf_dir)
    ws, _, _ = clean_folder(spark, folder, [JOURNAL_RULE], JOURNAL_TABLE)
    sql_clean(ws, SqlCleanPipeline("m1", ["门店账"], 'SELECT fen, "date" FROM "bt_门店账".entries', "entries"),
              {"门店账": "entries"})
    run_query(ws, QueryPipeline("sizes", BUCKET_SQL, "sizes", ["entries"]))
    return ws.read("master", "sizes")


ORACLES["bucket_histogram"] = f"""
SELECT CAST(length(CAST({sql_cents('o_totalprice')} AS VARCHAR)) AS INTEGER) AS digits, COUNT(*) AS n,
  CAST(SUM({sql_cents('o_totalprice')}) AS BIGINT) AS total, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last_day
FROM orders WHERE {sql_cents('o_totalprice')} > 0 GROUP BY 1"""


def clean_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped, typed columns plus the lineage of every row."""
    folder = FX.journal_folder(spark, sf_dir)
    _, _, df = clean_folder(spark, folder, [JOURNAL_RULE], JOURNAL_TABLE)
    return df.select("order_key", F.col("fen").alias("debit"), "date", "note",
                     path_part("__source_file", "prio").alias("prio"),
                     path_part("__source_file", "b").cast("int").alias("b"),
                     "__source_sheet", "__source_row", "__extracted_at")


ORACLES["clean_lineage"] = f"""
SELECT o_orderkey AS order_key, {sql_cents('o_totalprice')} AS debit,
       strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS note,
       o_orderpriority AS prio, CAST(o_orderkey % 4 AS INTEGER) AS b, 'csv' AS __source_sheet,
       CAST(1 + row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 4 ORDER BY o_orderkey) AS BIGINT)
         AS __source_row,
       '2024-01-01T00:00:00.000Z' AS __extracted_at
FROM orders"""


def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``**/`` folders, ``**`` suffix, literal ``?`` and case-sensitive names."""
    folder = FX.journal_folder(spark, sf_dir)
    rule = Rule("glob", [RuleSource("prio=1-URGENT/**/*.csv", 1), RuleSource("**/prio=2-HIGH/**", 1),
                         RuleSource("prio=?-LOW/*/*.csv", 1), RuleSource("*/b=*/part-*.CSV", 1)],
                [RuleField("订单号", "order_key", 0, True, ["none"])])
    cfg = BigTableConfig("glob", "g", [BigTableField("order_key", "INTEGER")])
    _, _, df = clean_folder(spark, folder, [rule], cfg)
    return df.select("order_key", path_part("__source_file", "prio").alias("prio"))


ORACLES["glob_match"] = """
SELECT o_orderkey AS order_key, o_orderpriority AS prio FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""


# ---------------------------------------------------------------- S3 / C5
DOC_RULE = Rule("docs", [RuleSource("**/*.csv", 1)], [
    RuleField("doc_id", "doc_id", 0, True, ["none"]),
    RuleField("text", "text", 1, True, ["none"]),
    RuleField("source", "source", 2, True, ["none"]),
    RuleField("n_chars", "n_chars", 3, True, ["none"]),
])
DOC_TABLE = BigTableConfig("docs", "documents", [BigTableField("doc_id", "INTEGER"), BigTableField("n_chars", "INTEGER")])


def csv_quoted_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: quoted fields with embedded newlines, quotes and commas survive; one
    record per document, record ordinals as lineage."""
    folder = FX.documents_folder(spark, sf_dir)
    _, _, df = clean_folder(spark, folder, [DOC_RULE], DOC_TABLE)
    return df.select("doc_id", "text", "source", "n_chars", path_part("__source_file", "lang").alias("lang"),
                     "__source_row")


ORACLES["csv_quoted_multiline"] = """
SELECT doc_id, text, source, n_chars, lang,
       CAST(1 + row_number() OVER (PARTITION BY lang, doc_id % 4 ORDER BY doc_id) AS BIGINT) AS __source_row
FROM documents"""


# ---------------------------------------------------------------- C2 / C6
MONEY_RULE = Rule("money", [RuleSource("**/*.csv", 1)], [
    RuleField("ok", "orderkey", 0, True, ["none"]), RuleField("ln", "linenumber", 1, True, ["none"]),
    RuleField("price", "price_cents", 2, True, ["coerce_cents"]),
    RuleField("yen", "yen_cents", 3, True, ["coerce_cents"]),
    RuleField("signed", "signed_cents", 4, True, ["coerce_cents"]),
])
MONEY_TABLE = BigTableConfig("money", "amounts", [
    BigTableField("orderkey", "INTEGER"), BigTableField("linenumber", "INTEGER"),
    BigTableField("price_cents", "INTEGER"), BigTableField("yen_cents", "INTEGER"),
    BigTableField("signed_cents", "INTEGER")])


def to_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money text (plain, ``¥1,234.56``, signed with Unicode padding) -> cents."""
    folder = FX.lineitem_money_folder(spark, sf_dir)
    _, _, df = clean_folder(spark, folder, [MONEY_RULE], MONEY_TABLE)
    return df.select("orderkey", "linenumber", "price_cents", "yen_cents", "signed_cents")


ORACLES["to_cents"] = f"""
SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber,
       {sql_cents('l_extendedprice')} AS price_cents,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS yen_cents,
       CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT)
         AS signed_cents
FROM lineitem"""


# ---------------------------------------------------------------- C3
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slashes / dots padded, Excel serials (with a time fraction too) to
    dates, periods kept, other text trimmed, blank -> ''."""
    folder = FX.dates_folder(spark, sf_dir)
    rule = Rule("dates", [RuleSource("**/*.csv", 1)], [RuleField("key", "key", 0, True, ["none"]),
                                                        RuleField("when", "day", 1, True, ["coerce_date"])])
    _, _, df = clean_folder(spark, folder, [rule], BigTableConfig("dates", "d", [BigTableField("key", "INTEGER")]))
    return df.select("key", "day")


ORACLES["normalize_date"] = """
SELECT o_orderkey AS key,
  CASE o_orderkey % 5
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m')
    WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
    ELSE CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END
  END AS day
FROM orders"""


# ---------------------------------------------------------------- C4 / C5
def trim_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 trims Unicode padding and turns blanks into NULL; C5 keeps text as is."""
    folder = FX.padded_folder(spark, sf_dir)
    rule = Rule("pad", [RuleSource("**/*.csv", 1)], [
        RuleField("id", "doc_id", 0, True, ["none"]), RuleField("padded", "src", 1, True, ["coerce_string"]),
        RuleField("maybe", "lang_trim", 2, True, ["coerce_string"]), RuleField("maybe", "lang_raw", 3, True, [])])
    _, _, df = clean_folder(spark, folder, [rule], BigTableConfig("pad", "p", [BigTableField("doc_id", "INTEGER")]))
    return df.select("doc_id", "src", "lang_trim", "lang_raw")


ORACLES["trim_null"] = """
SELECT doc_id, source AS src,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang_trim,
  CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END AS lang_raw
FROM documents"""


# ---------------------------------------------------------------- C7 / R5
COERCE_RULE = Rule("coerce", [RuleSource("**/*.csv", 1)], [
    RuleField("c_custkey", "key", 0, True, []), RuleField("c_acctbal", "bal_int", 1, True, []),
    RuleField("c_acctbal", "bal_real", 2, True, []), RuleField("whole", "whole_int", 3, True, []),
    RuleField("c_name", "name_int", 4, True, []), RuleField("c_custkey", "key_text", 5, True, [])])
COERCE_TABLE = BigTableConfig("coerce", "c", [
    BigTableField("key", "INTEGER"), BigTableField("bal_int", "INTEGER"), BigTableField("bal_real", "REAL"),
    BigTableField("whole_int", "INTEGER"), BigTableField("name_int", "INTEGER")])


def coerce_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text into INTEGER only when integral ('100.0' -> 100, '12.5' -> NULL),
    into REAL when numeric, anything else NULL (and counted as a reject)."""
    folder = FX.customer_folder(spark, sf_dir)
    _, _, df = clean_folder(spark, folder, [COERCE_RULE], COERCE_TABLE)
    return df.select("key", "bal_int", "bal_real", "whole_int", "name_int", "key_text")


_DEC = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)"
ORACLES["coerce_column"] = f"""
SELECT c_custkey AS key,
  CASE WHEN {_DEC} LIKE '%.00' THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS BIGINT) END AS bal_int,
  CAST({_DEC} AS DOUBLE) AS bal_real, c_custkey AS whole_int, CAST(NULL AS BIGINT) AS name_int,
  CAST(c_custkey AS VARCHAR) AS key_text
FROM customer"""


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects per column, counted by ``observe`` during the clean write."""
    folder = FX.customer_folder(spark, sf_dir)
    _, res, _ = clean_folder(spark, folder, [COERCE_RULE], COERCE_TABLE)
    return spark.createDataFrame(sorted(res.rejects.items()), "column_name string, rejected long")


ORACLES["reject_counts"] = f"""
SELECT * FROM (VALUES ('key', 0), ('bal_real', 0), ('whole_int', 0), ('key_text', 0)) t(column_name, rejected)
UNION ALL SELECT 'bal_int', COUNT(*) FILTER (WHERE {_DEC} NOT LIKE '%.00') FROM customer
UNION ALL SELECT 'name_int', COUNT(*) FROM customer"""


# ---------------------------------------------------------------- H1 / H2 / H4
def customer_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long header table per nation ("sheet"): each customer contributes one
    header cell (its segment, sometimes with a numeric suffix that collides with
    generated names), in customer-key order."""
    from pyspark.sql import Window
    c = FX.table(spark, sf_dir, "customer")
    h = F.when(F.col("c_custkey") % 3 == 0,
               F.concat(F.col("c_mktsegment"), F.lit("_"), (F.col("c_custkey") % 5).cast("string"))) \
         .otherwise(F.col("c_mktsegment"))
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return c.select(F.col("c_nationkey").alias("sheet"), (F.row_number().over(w) - 1).cast("int").alias("pos"),
                    h.alias("h"))


_CANON_SQL = """
long AS (SELECT c_nationkey AS sheet,
                CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos,
                CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '_' || CAST(c_custkey % 5 AS VARCHAR)
                     ELSE c_mktsegment END AS h
         FROM customer),
cnt AS (SELECT sheet, h, COUNT(*) AS cnt FROM long GROUP BY 1, 2),
ncols AS (SELECT sheet, COUNT(*) AS n FROM long GROUP BY 1),
cand AS (SELECT c.sheet, c.h, g.num, c.h || '_' || CAST(g.num AS VARCHAR) AS name
         FROM cnt c JOIN ncols n USING (sheet), LATERAL generate_series(1, c.cnt + n.n) g(num) WHERE c.cnt > 1),
free AS (SELECT sheet, h, name, row_number() OVER (PARTITION BY sheet, h ORDER BY num) AS occ
         FROM cand WHERE NOT EXISTS (SELECT 1 FROM long l WHERE l.sheet = cand.sheet AND l.h = cand.name)),
occ AS (SELECT l.sheet, l.pos, l.h, c.cnt, row_number() OVER (PARTITION BY l.sheet, l.h ORDER BY l.pos) AS occ
        FROM long l JOIN cnt c USING (sheet, h)),
canon AS (SELECT o.sheet, o.pos, o.h, o.cnt, CASE WHEN o.cnt = 1 THEN o.h ELSE f.name END AS name
          FROM occ o LEFT JOIN free f ON f.sheet = o.sheet AND f.h = o.h AND f.occ = o.occ)"""


def canonical_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: repeated headers numbered in column order, skipping raw names."""
    from ledgerloom.operators.headers import canonicalize
    return canonicalize(customer_headers(spark, sf_dir), ["sheet"]).select("sheet", "pos", "h", "name")


ORACLES["canonical_headers"] = f"WITH {_CANON_SQL} SELECT sheet, pos, h, name FROM canon"

# Mapping headers asked for in every sheet (bare repeated names,
# numbered names, a CR variant and an absent one).
WANTED_HEADERS = ["BUILDING", "AUTOMOBILE_1", "MACHINERY_2", "HOUSEHOLD\r", "FURNITURE_0\r", "WAREHOUSE_9"]


def resolve_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 + H4: exact canonical hit, bare repeated name -> duplicate, CR-free
    fallback, else absent."""
    from ledgerloom.operators.headers import canonicalize, resolve
    canon = canonicalize(customer_headers(spark, sf_dir), ["sheet"])
    sheets = canon.select("sheet").distinct()
    wanted = sheets.select("sheet", F.explode(F.array(*[F.lit(w) for w in WANTED_HEADERS])).alias("source_header"))
    return resolve(canon, wanted, ["sheet"]).select("sheet", "source_header", "status", "idx")


_WANTED_VALUES = ", ".join("('" + w.replace("\r", "' || chr(13) || '") + "')" for w in WANTED_HEADERS)
ORACLES["resolve_headers"] = f"""
WITH {_CANON_SQL},
wanted AS (SELECT s.sheet, w.source_header FROM (SELECT DISTINCT sheet FROM canon) s,
           (VALUES {_WANTED_VALUES}) w(source_header)),
dups AS (SELECT DISTINCT sheet, h FROM canon WHERE cnt > 1)
SELECT w.sheet, w.source_header,
  CASE WHEN e.pos IS NOT NULL THEN 'ok' WHEN d.h IS NOT NULL THEN 'duplicate'
       WHEN cr.pos IS NOT NULL THEN 'ok' ELSE 'absent' END AS status,
  COALESCE(e.pos, CASE WHEN d.h IS NULL THEN cr.pos END) AS idx
FROM wanted w
LEFT JOIN canon e ON e.sheet = w.sheet AND e.name = w.source_header
LEFT JOIN dups d ON d.sheet = w.sheet AND d.h = w.source_header
LEFT JOIN canon cr ON cr.sheet = w.sheet AND cr.name = replace(w.source_header, chr(13), '')
                  AND replace(w.source_header, chr(13), '') <> w.source_header"""


# ---------------------------------------------------------------- H3 / H8 / H9
def repeated_header_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H3: repeated headers are picked by number, and the numbers jump over a header that is spelled like one;
    the bare name would fail the whole run."""
    folder = FX.repeated_header_folder(spark, sf_dir)
    rule = Rule("meters", [RuleSource("**/*.csv", 1)], [
        RuleField("读数_5", "last", 0), RuleField("读数_1", "first", 1), RuleField("读数_3", "own", 2),
        RuleField("单位_2", "unit", 3), RuleField("站点", "station", 4)])
    _, _, df = clean_folder(spark, folder, [rule], BigTableConfig("meters", "m", [BigTableField("last", "INTEGER")]))
    return df.select("last", "first", "own", "unit", "station", "__source_row")


ORACLES["repeated_header_pick"] = """
SELECT c_custkey * 4 AS last, CAST(c_custkey AS VARCHAR) AS first, 'own ' || c_custkey AS own, 'u' || c_nationkey AS unit, c_name AS station,
  CAST(1 + row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS BIGINT) AS __source_row
FROM customer"""


def unused_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: source headers no mapping uses, over all files, sorted."""
    folder = FX.journal_folder(spark, sf_dir)
    _, res, _ = clean_folder(spark, folder, [JOURNAL_RULE], JOURNAL_TABLE)
    return res.unused_headers.withColumnRenamed("source_header", "header")


ORACLES["unused_headers"] = "SELECT * FROM (VALUES ('客户'), ('状态')) t(header)"


def mapping_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: each mapped header must hit in at least one matching file; bare
    repeated names are reported as duplicate, others as missing."""
    from ledgerloom.operators.clean import check_mapping
    from ledgerloom.plans.workspace import Workspace
    folder = FX.repeated_header_folder(spark, sf_dir)
    wanted = ["读数", "单位", "站点", "读数_4", "读数_6", "单位_1", "备注\r"]
    rule = Rule("meters", [RuleSource("**/*.csv", 1)], [RuleField(w, f"c{i}", i) for i, w in enumerate(wanted)])
    return check_mapping(Workspace(spark), folder, [rule])


ORACLES["mapping_check"] = """
SELECT * FROM (VALUES ('读数', 'duplicate'), ('单位', 'duplicate'), ('站点', NULL), ('读数_4', NULL), ('读数_6', 'missing'), ('单位_1', NULL),
                      ('备注' || chr(13), NULL)) t(source_header, problem) WHERE EXISTS (SELECT 1 FROM customer)"""


# ---------------------------------------------------------------- incremental (stream)
def incremental_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files picked up by a file stream (availableNow, a few files per
    micro-batch) and appended: same rows and lineage as one full clean."""
    from ledgerloom.config import CleanPipeline
    from ledgerloom.plans.workspace import Workspace
    from ledgerloom.streaming.incremental import incremental_clean as run
    from ledgerloom.suite.common import FIXED_EXTRACTED_AT
    folder = FX.journal_folder(spark, sf_dir)
    ws = Workspace(spark)
    run(ws, CleanPipeline("inc", folder, "门店账"), [JOURNAL_RULE], JOURNAL_TABLE, max_files_per_trigger=7,
        extracted_at=FIXED_EXTRACTED_AT)
    from ledgerloom.plans.workspace import bt_namespace
    df = ws.read(bt_namespace("门店账"), "entries")
    return df.select("order_key", F.col("fen").alias("debit"), "date", "note",
                     path_part("__source_file", "prio").alias("prio"),
                     path_part("__source_file", "b").cast("int").alias("b"),
                     "__source_sheet", "__source_row", "__extracted_at")


ORACLES["incremental_clean"] = ORACLES["clean_lineage"]
