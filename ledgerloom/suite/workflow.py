"""Checks of the stages around clean: rule union, master builds, copy-on-write
edits, append, ad-hoc cap, previews, exports, templates, coverage, drill-back,
run log, quickstart, listings, header detection and the dependency graph."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import (BigTableConfig, BigTableField, CleanPipeline, QueryPipeline, Rule, RuleField,
                               RuleSource, SqlCleanPipeline)
from ledgerloom.operators import detect as D
from ledgerloom.operators.clean import check_mapping, header_table, source_files  # noqa: F401
from ledgerloom.plans import adhoc as A
from ledgerloom.plans import export as X
from ledgerloom.plans import impact as G
from ledgerloom.plans.rebuild import Project, quickstart as run_quickstart, rebuild
from ledgerloom.plans.stages import run_query, sql_clean
from ledgerloom.plans.workspace import MASTER, Workspace, bt_namespace
from ledgerloom.sources.csvrows import csv_raw_rows
from ledgerloom.suite import fixtures as FX
from ledgerloom.suite.common import clean_folder, path_part, sql_cents
from ledgerloom.suite.ingest import _CANON_SQL, BUCKET_SQL, DOC_RULE, DOC_TABLE, JOURNAL_RULE, JOURNAL_TABLE
from ledgerloom.suite.relational import master_workspace

ORACLES: dict[str, str] = {}
RF = RuleField
BTF = BigTableField

# ---------------------------------------------------------------- R1-R4
UNION_RULES = [
    Rule("a_customer", [RuleSource("customer/**/*.csv", 1)], [
        RF("c_custkey", "key", 0), RF("c_name", "name", 1, True, ["coerce_string"]),
        RF("c_acctbal", "balance", 2, True, ["coerce_cents"]), RF("c_mktsegment", "segment", 3)]),
    Rule("b_supplier", [RuleSource("supplier/**/*.csv", 1)], [
        RF("s_suppkey", "key", 0), RF("s_name", "name", 1),
        RF("s_acctbal", "balance", 2, True, ["coerce_cents"]), RF("s_nationkey", "nation", 3)]),
    # same source key as a_customer: ignored for that source (R3), its new column stays empty
    Rule("c_repeat", [RuleSource("customer/**/*.csv", 1)], [RF("c_nationkey", "nation", 0), RF("c_name", "alias", 1)]),
]
UNION_TABLE = BigTableConfig("people", "people", [BTF("key", "INTEGER"), BTF("balance", "INTEGER"),
                                                   BTF("nation", "INTEGER")])


def rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule maps its own files; the table has every rule's columns;
    a repeated source key is ignored (R3)."""
    root = FX.fresh_dir(spark, "people")
    FX.customer_folder(spark, sf_dir, sub=os.path.join(root, "customer"))
    FX.supplier_folder(spark, sf_dir, os.path.join(root, "supplier"))
    _, _, df = clean_folder(spark, root, UNION_RULES, UNION_TABLE)
    kind = F.regexp_extract("__source_file", "/(customer|supplier)/", 1)
    return df.select("key", "name", "balance", "segment", "nation", "alias", kind.alias("kind"))


ORACLES["rule_union"] = f"""
SELECT c_custkey AS key, c_name AS name, {sql_cents('c_acctbal')} AS balance, c_mktsegment AS segment,
       CAST(NULL AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS alias, 'customer' AS kind FROM customer
UNION ALL
SELECT s_suppkey, s_name, {sql_cents('s_acctbal')}, NULL, CAST(s_nationkey AS BIGINT), NULL, 'supplier' FROM supplier"""


# ---------------------------------------------------------------- M3 with two big tables
CUST_RULE = Rule("cust", [RuleSource("**/*.csv", 1)], [
    RF("c_custkey", "key", 0), RF("c_name", "name", 1), RF("c_acctbal", "balance", 2, True, ["coerce_cents"]),
    RF("c_mktsegment", "segment", 3), RF("c_nationkey", "nation", 4)])
CUST_TABLE = BigTableConfig("客户", "cust", [BTF("key", "INTEGER"), BTF("balance", "INTEGER"), BTF("nation", "INTEGER")])
JOURNAL_CUST_RULE = Rule("journal2", [RuleSource("**/*.csv", 1)], JOURNAL_RULE.fields + [RF("客户", "cust_key", 9)])
JOURNAL_CUST_TABLE = BigTableConfig("门店账", "entries", JOURNAL_TABLE.fields + [BTF("cust_key", "INTEGER")])


def master_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 over two big tables in one SQL (Q3 namespaces with non-ASCII folder names)."""
    ws = Workspace(spark)
    clean_folder(spark, FX.journal_folder(spark, sf_dir), [JOURNAL_CUST_RULE], JOURNAL_CUST_TABLE, ws)
    clean_folder(spark, FX.customer_folder(spark, sf_dir), [CUST_RULE], CUST_TABLE, ws)
    sql = ('SELECT o.order_key, o.fen AS debit, c.name, c.segment '
           'FROM "bt_门店账".entries o JOIN "bt_客户".cust c ON o.cust_key = c.key')
    sql_clean(ws, SqlCleanPipeline("m2", ["门店账", "客户"], sql, "order_customer"), {"门店账": "entries", "客户": "cust"})
    return ws.read(MASTER, "order_customer")


ORACLES["master_two_tables"] = f"""
SELECT o_orderkey AS order_key, {sql_cents('o_totalprice')} AS debit, c_name AS name, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey"""


# ---------------------------------------------------------------- Q9 / M2
def _customers(spark, sf_dir):
    ws = Workspace(spark)
    clean_folder(spark, FX.customer_folder(spark, sf_dir), [CUST_RULE], CUST_TABLE, ws)
    return ws, bt_namespace("客户")


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 UPDATE as a staged copy-on-write rewrite."""
    ws, ns = _customers(spark, sf_dir)
    n = ws.update_where(ns, "cust", "segment = 'BUILDING'", {"balance": "balance + 100"})
    return ws.read(ns, "cust").select("key", "balance", "segment", F.lit(n).alias("changed"))


ORACLES["update_where"] = f"""
SELECT c_custkey AS key,
  {sql_cents('c_acctbal')} + CASE WHEN c_mktsegment = 'BUILDING' THEN 100 ELSE 0 END AS balance,
  c_mktsegment AS segment, (SELECT COUNT(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS changed
FROM customer"""


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 DELETE as a staged copy-on-write rewrite."""
    ws, ns = _customers(spark, sf_dir)
    n = ws.delete_where(ns, "cust", "nation = 0 OR balance < 0")
    return ws.read(ns, "cust").select("key", "nation", F.lit(n).alias("deleted"))


ORACLES["delete_where"] = f"""
SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS nation,
  (SELECT COUNT(*) FROM customer WHERE c_nationkey = 0 OR {sql_cents('c_acctbal')} < 0) AS deleted
FROM customer WHERE NOT (c_nationkey = 0 OR {sql_cents('c_acctbal')} < 0)"""


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: append a batch to an existing big table (here: its own rows again)."""
    ws, ns = _customers(spark, sf_dir)
    ws.append(ws.read(ns, "cust"), ns, "cust")
    return ws.read(ns, "cust").select("key", "name", "__source_row")


ORACLES["append_rows"] = """
WITH once AS (SELECT c_custkey AS key, c_name AS name,
  CAST(1 + row_number() OVER (PARTITION BY c_mktsegment, c_custkey % 4 ORDER BY c_custkey) AS BIGINT) AS __source_row
  FROM customer)
SELECT * FROM once UNION ALL SELECT * FROM once"""


# ---------------------------------------------------------------- Q5 / Q6 / Q7 / S12 / S13
def adhoc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: reader statements come back capped at 5000 rows with an exact flag."""
    ws = master_workspace(spark, sf_dir)
    r = A.adhoc(ws, "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber;")
    return r.df.withColumn("truncated", F.lit(r.truncated))


ORACLES["adhoc_cap"] = """
SELECT l_orderkey, l_linenumber, (SELECT COUNT(*) FROM lineitem) > 5000 AS truncated
FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 5000"""


def _journal(spark, sf_dir, ws=None):
    return clean_folder(spark, FX.journal_folder(spark, sf_dir), [JOURNAL_RULE], JOURNAL_TABLE, ws)


def adhoc_on_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: ad-hoc SQL scoped to one big table's namespace, all rows."""
    ws, _, _ = _journal(spark, sf_dir)
    r = A.adhoc(ws, 'SELECT order_key, note FROM entries WHERE fen > 30000000', folder="门店账", capped=False)
    return r.df


ORACLES["adhoc_on_table"] = f"""
SELECT o_orderkey AS order_key, o_orderpriority AS note FROM orders WHERE {sql_cents('o_totalprice')} > 30000000"""


def preview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: a page of a big table in lineage order, with the total."""
    ws, res, _ = _journal(spark, sf_dir)
    page, total = A.preview_table(ws, res.namespace, res.table, offset=100, limit=50)
    return page.select("order_key", "__source_row", F.lit(total).alias("total"))


ORACLES["preview_page"] = """
SELECT o_orderkey AS order_key,
  CAST(1 + row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 4 ORDER BY o_orderkey) AS BIGINT) AS __source_row,
  (SELECT COUNT(*) FROM orders) AS total
FROM orders ORDER BY o_orderpriority, o_orderkey % 4, o_orderkey LIMIT 50 OFFSET 100"""


def table_scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 + D1: scan a stored table with projection and filter (pushed to Parquet)."""
    ws, res, _ = _journal(spark, sf_dir)
    return ws.read(res.namespace, res.table).filter(F.col("note") == "1-URGENT").select("order_key", "date")


ORACLES["table_scan_project"] = """
SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderpriority = '1-URGENT'"""


def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offset/limit page of every source sheet's data rows, with totals."""
    ws, res, _ = _journal(spark, sf_dir)
    raw = res.raw_rows
    page = A.preview_source(raw, header_row=1, offset=10, limit=5)
    return page.select(path_part("source_file", "prio").alias("prio"), "row_no",
                       F.get("cells", 0).alias("order_key"), "total")


ORACLES["source_preview"] = """
SELECT prio, CAST(rn + 1 AS BIGINT) AS row_no, CAST(o_orderkey AS VARCHAR) AS order_key, total FROM (
  SELECT o_orderpriority AS prio, o_orderkey,
         row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 4 ORDER BY o_orderkey) AS rn,
         COUNT(*) OVER (PARTITION BY o_orderpriority, o_orderkey % 4) AS total
  FROM orders) WHERE rn BETWEEN 11 AND 15"""


# ---------------------------------------------------------------- M5 / M6 / M7 / C9
def _read_back(spark, path):
    raw = csv_raw_rows(spark, path)
    return raw.filter(F.col("row_no") > 1)


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: export a master query to CSV, read it back with the CSV scan."""
    ws, _, _ = _journal(spark, sf_dir)
    sql_clean(ws, SqlCleanPipeline("m1", ["门店账"], 'SELECT * FROM "bt_门店账".entries', "entries"), {"门店账": "entries"})
    out = FX.fresh_dir(spark, "export_query")
    X.export_query(ws, 'SELECT order_key, fen, date, note FROM entries', out)
    back = _read_back(spark, out)
    return back.select(*[F.get("cells", i).alias(n) for i, n in enumerate(["order_key", "debit", "date", "note"])],
                       F.size("cells").alias("n_cells"))


ORACLES["csv_export"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST({sql_cents('o_totalprice')} AS VARCHAR) AS debit,
  strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS note, 4 AS n_cells FROM orders"""


def table_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + C9: a big table without lineage columns; texts with quotes, commas
    and newlines round-trip through the writer and the CSV scan."""
    ws = Workspace(spark)
    clean_folder(spark, FX.documents_folder(spark, sf_dir), [DOC_RULE], DOC_TABLE, ws)
    out = FX.fresh_dir(spark, "export_table")
    X.export_table(ws, DOC_TABLE, out)
    back = _read_back(spark, out)
    return back.select(F.get("cells", 0).cast("long").alias("doc_id"), F.get("cells", 1).alias("text"),
                       F.size("cells").alias("n_cells"))


ORACLES["table_export"] = "SELECT doc_id, text, 4 AS n_cells FROM documents"


def sheet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: one source sheet exported with its canonical headers, in source order."""
    folder = FX.journal_folder(spark, sf_dir)
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(folder) for f in fs
             if f.endswith(".csv") and "prio=1-URGENT" in dp and dp.endswith("b=0")]
    ws = Workspace(spark)
    out = FX.fresh_dir(spark, "export_sheet")
    X.export_source_sheet(ws, files[0], out)
    back = _read_back(spark, out)
    return back.select(F.get("cells", 0).alias("order_key"), F.get("cells", 3).alias("amount"),
                       F.get("cells", 5).alias("note"))


ORACLES["sheet_export"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  ' ' || o_orderpriority || ' ' AS note
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0"""


# ---------------------------------------------------------------- D2 / D23-D25 in a sql-clean
def drop_subtotals_add_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotal rows dropped and a month derived in the sql-clean SQL."""
    o = FX.table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    data = o.select(F.col("o_orderpriority").alias("prio"), F.col("o_orderkey").alias("_ord"),
                    F.col("o_orderkey").cast("string").alias("c0"), F.col("o_custkey").cast("string").alias("c1"),
                    F.col("o_orderstatus").alias("c2"), FX.money_text("o_totalprice").alias("c3"),
                    F.date_format("o_orderdate", "yyyy/M/d").alias("c4"), F.col("o_orderpriority").alias("c5"))
    sub = (o.groupBy(F.col("o_orderpriority").alias("prio"))
            .agg(F.sum(cents).alias("s"))
            .select("prio", F.lit(9_000_000_000_000_000_000).alias("_ord"), F.lit("").alias("c0"),
                    F.lit("").alias("c1"), F.lit("").alias("c2"),
                    F.format_string("%d.%02d", F.floor(F.col("s") / 100), F.col("s") % 100).alias("c3"),
                    F.lit("").alias("c4"), F.lit("小计").alias("c5")))
    out = FX.fresh_dir(spark, "subtotals")
    FX.write_csv_rows(data.unionByName(sub), out, ["prio"], list(FX.JOURNAL_HEADERS))
    ws, _, _ = clean_folder(spark, out, [JOURNAL_RULE], JOURNAL_TABLE)
    sql = ('SELECT order_key, fen AS debit, substr(date, 1, 7) AS month FROM "bt_门店账".entries '
           "WHERE note NOT LIKE '%小计%' AND order_key IS NOT NULL")
    sql_clean(ws, SqlCleanPipeline("m", ["门店账"], sql, "journal_clean"), {"门店账": "entries"})
    return ws.read(MASTER, "journal_clean")


ORACLES["drop_subtotals_add_month"] = f"""
SELECT o_orderkey AS order_key, {sql_cents('o_totalprice')} AS debit, strftime(o_orderdate, '%Y-%m') AS month
FROM orders"""


# ---------------------------------------------------------------- H10 / H11 / R6 / C10
def guess_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount-like headers -> INTEGER + to-cents, others TEXT + none."""
    from ledgerloom.operators.rules import plan_rules
    from ledgerloom.sources.files import list_files, match_files
    from ledgerloom.operators.clean import load_raw_rows
    folder = FX.journal_folder(spark, sf_dir)
    ws = Workspace(spark)
    plan = plan_rules([JOURNAL_RULE])
    files = list_files(spark, folder)
    matched = match_files(files, plan.sources_df(spark))
    raw, sheets, _ = load_raw_rows(ws, folder, files, matched)
    canon = header_table(raw, source_files(matched, sheets))
    return D.guess_mapping(canon).select("source_header", "output_name", "type", "transform").distinct()


ORACLES["guess_mapping"] = """
SELECT h AS source_header, h AS output_name,
  CASE WHEN h = '借方金额' THEN 'INTEGER' ELSE 'TEXT' END AS type,
  CASE WHEN h = '借方金额' THEN 'to-cents' ELSE 'none' END AS transform
FROM (VALUES ('订单号'), ('客户'), ('状态'), ('借方金额'), ('日期'), ('摘要')) t(h)"""


def template_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved template (every segment, bare and numbered) applied to the header row of each nation."""
    from ledgerloom.operators import headers as H
    from ledgerloom.operators.templates import template_report
    from ledgerloom.suite.ingest import customer_headers
    canon = H.canonicalize(customer_headers(spark, sf_dir), ["sheet"])
    segments = FX.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    tpl = segments.select(F.explode(F.array("c_mktsegment", F.concat("c_mktsegment", F.lit("_4")))).alias("source_header"),
                          F.lit("x").alias("output_name"), F.lit("none").alias("transform"))
    return template_report(canon, tpl, ["sheet"]).select("sheet", "matched", F.array_join("skipped", "|").alias("skipped"))


ORACLES["template_apply"] = f"""
WITH {_CANON_SQL},
tpl AS (SELECT DISTINCT unnest([c_mktsegment, c_mktsegment || '_4']) AS t FROM customer),
pairs AS (SELECT s.sheet, tpl.t, EXISTS (SELECT 1 FROM canon c WHERE c.sheet = s.sheet AND c.name = tpl.t) AS hit FROM (SELECT DISTINCT sheet FROM canon) s, tpl)
SELECT sheet, CAST(COUNT(*) FILTER (WHERE hit) AS INTEGER) AS matched, COALESCE(string_agg(t, '|' ORDER BY t) FILTER (WHERE NOT hit), '') AS skipped
FROM pairs GROUP BY sheet"""


def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sheets some rule covers (glob on base name or path + sheet name)."""
    from ledgerloom.operators.rules import plan_rules, rule_coverage as coverage
    from ledgerloom.sources.files import csv_sheets, list_files
    folder = FX.journal_folder(spark, sf_dir)
    rules = [Rule("u", [RuleSource("prio=1-URGENT/**", 1)], [RF("订单号", "k", 0)]),
             Rule("b0", [RuleSource("**/b=0/*.csv", 1, sheet_name="csv")], [RF("订单号", "k", 0)]),
             Rule("never", [RuleSource("**/*.csv", 1, sheet_name="Sheet1")], [RF("订单号", "k", 0)])]
    files = list_files(spark, folder)
    cov = coverage(csv_sheets(files), files, plan_rules(rules).sources_df(spark))
    return cov.select(F.regexp_extract("rel_path", "prio=([^/]+)/", 1).alias("prio"),
                      F.regexp_extract("rel_path", "/b=([0-9]+)/", 1).cast("int").alias("b"),
                      "covered", F.array_join(F.transform("rules", lambda x: x.cast("string")), ",").alias("rules"))


ORACLES["rule_coverage"] = """
SELECT prio, b, rules <> '' AS covered, rules FROM (
  SELECT DISTINCT o_orderpriority AS prio, CAST(o_orderkey % 4 AS INTEGER) AS b,
    concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' THEN '0' END,
                   CASE WHEN o_orderkey % 4 = 0 THEN '1' END) AS rules
  FROM orders)"""


def drill_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows joined back to their source rows through the lineage."""
    from ledgerloom.operators.clean import drill_back as drill
    _, res, df = _journal(spark, sf_dir)
    raw = res.raw_rows
    return drill(df, raw).select("order_key", F.get("cells", 3).alias("source_amount"))


ORACLES["drill_back"] = """
SELECT o_orderkey AS order_key, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS source_amount FROM orders"""


# ---------------------------------------------------------------- G6 / G8 / G9 / Q8
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 + G8: a rebuild in dependency order; every run logged with its rows."""
    folder = FX.journal_folder(spark, sf_dir)
    ws = Workspace(spark)
    proj = Project(
        [QueryPipeline("sizes", BUCKET_SQL, "sizes", ["entries"]),
         SqlCleanPipeline("m1", ["门店账"], 'SELECT fen, "date" FROM "bt_门店账".entries', "entries"),
         CleanPipeline("c1", folder, "门店账")],
        [JOURNAL_TABLE], {"门店账": [JOURNAL_RULE]})
    rebuild(ws, proj)
    return ws.run_log().select("pipeline_id", "kind", "ok", "rows")


ORACLES["run_summary"] = """
SELECT * FROM (VALUES ('c1', 'clean', true), ('m1', 'sql-clean', true), ('sizes', 'query', true)) t(pipeline_id, kind, ok)
JOIN (SELECT 'c1' AS pipeline_id, COUNT(*) AS rows FROM orders
      UNION ALL SELECT 'm1', COUNT(*) FROM orders
      UNION ALL SELECT 'sizes', COUNT(DISTINCT length(CAST(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS VARCHAR)))
      FROM orders) r USING (pipeline_id)"""


def quickstart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect header, guess mappings, clean, copy to master, verify counts."""
    folder = FX.journal_folder(spark, sf_dir)
    ws = Workspace(spark)
    _, runs = run_quickstart(ws, folder, "journal", "entries")
    bad = [r for r in runs if not r.ok]
    if bad:
        raise RuntimeError(bad[0].error)
    return ws.read(MASTER, "entries").select("订单号", "借方金额", "日期", "摘要")


ORACLES["quickstart"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS "订单号", {sql_cents('o_totalprice')} AS "借方金额",
  strftime(o_orderdate, '%Y/%-m/%-d') AS "日期", ' ' || o_orderpriority || ' ' AS "摘要" FROM orders"""


def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: tables of the master namespace with their columns and types."""
    ws, _, _ = _journal(spark, sf_dir)
    sql_clean(ws, SqlCleanPipeline("m1", ["门店账"], 'SELECT fen, "date" FROM "bt_门店账".entries', "entries"),
              {"门店账": "entries"})
    run_query(ws, QueryPipeline("q", BUCKET_SQL, "sizes", ["entries"]))
    return ws.list_tables(MASTER)


ORACLES["table_listing"] = """
SELECT * FROM (VALUES ('sizes', 'digits', 'int', 0), ('sizes', 'n', 'bigint', 1),
                      ('sizes', 'total', 'bigint', 2), ('sizes', 'last_day', 'string', 3),
                      ('entries', 'fen', 'bigint', 0), ('entries', 'date', 'string', 1))
  t("table", "column", "type", "position")"""


# ---------------------------------------------------------------- H5-H7 over text lines
def doc_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_rows from documents: one sheet per document, one row per text line,
    one cell per space-separated word (whole texts)."""
    d = FX.table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_file"),
                        F.lit("csv").alias("source_sheet"), (F.col("pos") + 1).cast("long").alias("row_no"),
                        F.split("line", " ", -1).alias("cells"), F.lit(None).cast("string").alias("kinds"))


def _doc_id():
    return F.regexp_extract("source_file", "doc:([0-9]+)", 1).cast("long").alias("doc_id")


def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: text cell 2, other non-empty 1, empty or plain number 0."""
    raw = doc_line_rows(spark, sf_dir)
    return raw.select(_doc_id(), "row_no", D.row_score(F.col("cells"), F.col("kinds")).alias("score"))


_LINES_SQL = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS row_no FROM documents),
words AS (SELECT doc_id, row_no, unnest(string_split(line, ' ')) AS w FROM lines),
scores AS (SELECT doc_id, row_no,
             CAST(SUM(CASE WHEN trim(w) = '' OR regexp_matches(trim(w), '^-?[0-9]+([.,][0-9]+)?$') THEN 0 ELSE 2 END)
                  AS INTEGER) AS score,
             bool_and(trim(w) = '') AS blank
           FROM words GROUP BY doc_id, row_no)"""

ORACLES["header_score"] = f"WITH {_LINES_SQL} SELECT doc_id, row_no, score FROM scores"


def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: best of the first 10 rows, earliest on ties, -1 / row 1 when none."""
    return D.detect_header_row(doc_line_rows(spark, sf_dir)).select(_doc_id(), "header_index", "header_row", "score")


ORACLES["header_detect"] = f"""
WITH {_LINES_SQL},
best AS (SELECT doc_id, first(row_no ORDER BY score DESC, row_no) AS best_row, MAX(score) AS score
         FROM scores WHERE row_no <= 10 AND score > 0 GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(best_row - 1, -1) AS INTEGER) AS header_index,
       CAST(COALESCE(best_row, 1) AS INTEGER) AS header_row, COALESCE(b.score, 0) AS score
FROM documents d LEFT JOIN best b USING (doc_id)"""


def header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: rare high-scoring rows (stacked tables), ranked by deviation from the mode."""
    c = D.header_candidates(doc_line_rows(spark, sf_dir))
    return c.select(_doc_id(), "row_no", "score", "deviation", "rank", F.get("cells", 0).alias("first_cell"))


ORACLES["header_candidates"] = f"""
WITH {_LINES_SQL},
last AS (SELECT doc_id, MAX(row_no) AS last_row FROM scores WHERE NOT blank GROUP BY doc_id),
sc AS (SELECT s.* FROM scores s JOIN last USING (doc_id) WHERE NOT blank AND row_no <= last_row),
freq AS (SELECT doc_id, score, COUNT(*) AS freq FROM sc GROUP BY 1, 2),
mode AS (SELECT doc_id, first(score ORDER BY freq DESC, score DESC) AS mode FROM freq GROUP BY 1),
cand AS (SELECT sc.doc_id, sc.row_no, sc.score, sc.score - mode AS deviation
         FROM sc JOIN freq USING (doc_id, score) JOIN mode USING (doc_id)
         WHERE sc.score >= 3 AND sc.score > mode AND freq <= 2),
firsts AS (SELECT doc_id, row_no, string_split(line, ' ')[1] AS w0 FROM lines)
SELECT c.doc_id, c.row_no, c.score, c.deviation,
  CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.deviation DESC, c.row_no) AS INTEGER) AS rank,
  CASE WHEN length(w0) > 60 THEN substr(w0, 1, 59) || '…' ELSE w0 END AS first_cell
FROM cand c JOIN firsts f USING (doc_id, row_no)"""


# ---------------------------------------------------------------- G1-G4 on a data-sized graph
def lineitem_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependency graph that grows with the data: supplier -> part -> order."""
    li = FX.table(spark, sf_dir, "lineitem")
    a = li.select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"),
                  F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"))
    b = li.select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("src"),
                  F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("dst"))
    return a.union(b).distinct()


def _start(spark, sf_dir):
    return FX.table(spark, sf_dir, "lineitem").agg(
        F.concat(F.lit("s:"), F.min("l_suppkey").cast("string")).alias("id"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_edges(spark, sf_dir)


_EDGES_SQL = """
e AS (SELECT DISTINCT 's:' || CAST(l_suppkey AS VARCHAR) AS src, 'p:' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem
      UNION SELECT DISTINCT 'p:' || CAST(l_partkey AS VARCHAR), 'o:' || CAST(l_orderkey AS VARCHAR) FROM lineitem),
start AS (SELECT 's:' || CAST(MIN(l_suppkey) AS VARCHAR) AS id FROM lineitem)"""
ORACLES["graph_edges"] = f"WITH {_EDGES_SQL} SELECT src, dst FROM e"


def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything downstream of one supplier (breadth-first joins)."""
    return G.affected(lineitem_edges(spark, sf_dir), _start(spark, sf_dir))


ORACLES["impact_closure"] = f"""
WITH RECURSIVE {_EDGES_SQL},
r(id) AS (SELECT e.dst FROM e JOIN start ON e.src = start.id UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)
SELECT id FROM r"""


def rebuild_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected nodes with their longest-path level (recompute order)."""
    return G.recompute_order(lineitem_edges(spark, sf_dir), _start(spark, sf_dir))


ORACLES["rebuild_order"] = f"""
WITH RECURSIVE {_EDGES_SQL},
r(id, depth) AS (SELECT e.dst, 1 FROM e JOIN start ON e.src = start.id
                 UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id)
SELECT id, CAST(MAX(depth) AS INTEGER) AS level FROM r GROUP BY id"""


# ---------------------------------------------------------------- C6 / G2 / G7
def to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money text -> number without scaling (marks and Unicode spaces removed)."""
    from ledgerloom.functions.transforms import to_number as num
    li = FX.table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    text = F.concat(F.lit("¥ "), F.format_number(F.floor(cents / 100), 0), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("　"))
    return li.select("l_orderkey", "l_linenumber", num(text, F.lit("s")).alias("amount"))


ORACLES["to_number"] = """
SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0 AS amount FROM lineitem"""


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct downstream of the first supplier and direct upstream of the first order."""
    e = lineitem_edges(spark, sf_dir)
    li = FX.table(spark, sf_dir, "lineitem")
    first = li.agg(F.min("l_suppkey").alias("s"), F.min("l_orderkey").alias("o")).first()
    down = G.downstream(e, f"s:{first['s']}").select(F.lit("down").alias("dir"), "id")
    up = G.upstream(e, f"o:{first['o']}").select(F.lit("up").alias("dir"), "id")
    return down.unionByName(up)


ORACLES["graph_neighbours"] = """
SELECT DISTINCT 'down' AS dir, 'p:' || CAST(l_partkey AS VARCHAR) AS id FROM lineitem
WHERE l_suppkey = (SELECT MIN(l_suppkey) FROM lineitem)
UNION ALL
SELECT DISTINCT 'up', 'p:' || CAST(l_partkey AS VARCHAR) FROM lineitem
WHERE l_orderkey = (SELECT MIN(l_orderkey) FROM lineitem)"""


def batch_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run every clean pipeline of a project (dependency order), then every sql-clean."""
    from ledgerloom.plans.rebuild import run_batch
    ws = Workspace(spark)
    proj = Project(
        [SqlCleanPipeline("m_cust", ["客户"], 'SELECT key, segment FROM "bt_客户".cust', "cust"),
         CleanPipeline("c_cust", FX.customer_folder(spark, sf_dir), "客户"),
         CleanPipeline("c_journal", FX.journal_folder(spark, sf_dir), "门店账")],
        [JOURNAL_TABLE, CUST_TABLE], {"门店账": [JOURNAL_RULE], "客户": [CUST_RULE]})
    run_batch(ws, proj, kind="clean")
    run_batch(ws, proj, kind="sql-clean")
    return ws.run_log().select("pipeline_id", "kind", "ok", "rows")


ORACLES["batch_by_kind"] = """
SELECT 'c_cust' AS pipeline_id, 'clean' AS kind, true AS ok, COUNT(*) AS rows FROM customer
UNION ALL SELECT 'c_journal', 'clean', true, COUNT(*) FROM orders
UNION ALL SELECT 'm_cust', 'sql-clean', true, COUNT(*) FROM customer"""


def duplicate_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """primaryKey as a duplicate-key report: after appending a batch twice, every
    customer key is held by two rows."""
    from ledgerloom.operators.clean import duplicate_keys
    ws, ns = _customers(spark, sf_dir)
    ws.append(ws.read(ns, "cust"), ns, "cust")
    cfg = BigTableConfig("客户", "cust", [BTF("key", "INTEGER", 0, True), BTF("balance", "INTEGER")])
    return duplicate_keys(ws, cfg)


ORACLES["duplicate_key_report"] = "SELECT c_custkey AS key, CAST(2 AS BIGINT) AS n FROM customer"
