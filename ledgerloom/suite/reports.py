"""Checks of reports and changes: sheet listing, quarantine, rejected values, setup from mixed folders, UPDATE / DELETE text,
recursion and group frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, BigTableField, Rule, RuleField, RuleSource
from ledgerloom.operators.frames import groups_frame
from ledgerloom.plans import inspect
from ledgerloom.plans.adhoc import adhoc
from ledgerloom.plans.rebuild import quickstart
from ledgerloom.plans.statements import run_sql
from ledgerloom.plans.workspace import MASTER
from ledgerloom.suite import fixtures as FX
from ledgerloom.suite.common import clean_folder, path_part
from ledgerloom.suite.relational import master_workspace
from ledgerloom.suite.workflow import _customers
from ledgerloom.suite.xlsx_fixture import orders_workbooks, plain_workbooks

ORACLES: dict[str, str] = {}
_CENTS = "CAST(floor(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)::DOUBLE * 100 + 0.5) AS BIGINT)"


def sheet_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet of a folder of workbooks and CSV files, listed without parsing a sheet."""
    folder = orders_workbooks(spark, sf_dir)
    o = FX.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prio"), F.col("o_orderkey").alias("k"))
    FX.write_csv_folder(o, f"{folder}/csv", ["prio"], ["k"])
    return inspect.sheets(spark, folder).select(path_part("source_file", "prio").alias("prio"),
                                                F.regexp_extract("source_file", "\\.([a-z]+)$", 1).alias("kind"), "sheet_name", "sheet_pos")


ORACLES["sheet_listing"] = """
WITH books AS (SELECT DISTINCT o_orderpriority AS prio, o_orderkey % 4 AS b FROM orders)
SELECT prio, 'xlsx' AS kind, '说明' AS sheet_name, 0 AS sheet_pos FROM books
UNION ALL SELECT prio, 'xlsx', 'orders', 1 FROM books
UNION ALL SELECT DISTINCT prio, 'csv', 'csv', 0 FROM books"""


def quarantine_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 for CSV: a file that cannot be read to its end is skipped as a whole and reported, one with an open quote is read and
    reported, the rest loads."""
    c = FX.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    folder = FX.write_csv_folder(c, FX.fresh_dir(spark, "quarantine"), ["nation"], ["key"])
    FX.damage(spark, folder, "nation=3")
    four = c.filter("nation = 4").select("nation").distinct()
    lines = four.select("nation", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("key,name").alias("value")), F.struct(F.lit(1).alias("o"), F.lit('"open,x').alias("value")))).alias("l"))
    (lines.select("nation", "l.*").repartition("nation").sortWithinPartitions("nation", "o").select("nation", "value")
     .write.options(header="false", quote="", sep="\u0002").partitionBy("nation").csv(f"{folder}/more"))
    rule = Rule("r", [RuleSource("**/*.csv", 1)], [RuleField("key", "key", 0), RuleField("name", "name", 1)])
    _, res, df = clean_folder(spark, folder, [rule], BigTableConfig("quarantine", "t", []))
    rows = df.select(path_part("__source_file", "nation").alias("nation"), F.lit("row").alias("what"), "key")
    notes = res.rejected_files.select(path_part("path", "nation").alias("nation"), F.when(F.col("skipped"), F.lit("skipped")).otherwise(F.lit("noted")).alias("what"),
                                      F.col("problem").alias("key"))
    return rows.unionByName(notes)


ORACLES["quarantine_csv"] = """
SELECT CAST(c_nationkey AS VARCHAR) AS nation, 'row' AS what, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT '4', 'row', 'open,x' || chr(10) FROM customer WHERE c_nationkey = 4 GROUP BY c_nationkey
UNION ALL SELECT '3', 'skipped', 'not all bytes could be read' FROM customer WHERE c_nationkey = 3 GROUP BY c_nationkey
UNION ALL SELECT '4', 'noted', 'ends inside quotes' FROM customer WHERE c_nationkey = 4 GROUP BY c_nationkey"""


def reject_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a column's type rejects, per file and column, with samples, from the run's own write."""
    rule = Rule("r", [RuleSource("**/*.csv", 1)], [RuleField("c_name", "number", 0), RuleField("c_custkey", "key", 1), RuleField("c_mktsegment", "cents", 2, True, ["coerce_cents"])])
    cfg = BigTableConfig("rejects", "t", [BigTableField("number", "REAL"), BigTableField("key", "INTEGER"), BigTableField("cents", "INTEGER")])
    _, res, _ = clean_folder(spark, FX.customer_folder(spark, sf_dir), [rule], cfg)
    found = res.reject_detail.groupBy("column").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), "|").alias("samples"),
                                                    F.min("first_row").alias("first_row"))
    return found.withColumn("samples", F.when(F.col("column") == "cents", F.col("samples"))).withColumnRenamed("column", "name")


ORACLES["reject_detail"] = """
SELECT 'number' AS name, COUNT(*) AS n, CAST(NULL AS VARCHAR) AS samples, CAST(2 AS BIGINT) AS first_row FROM customer
UNION ALL SELECT 'cents', COUNT(*), (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)), 2 FROM customer"""


def quickstart_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 on a mixed folder: workbooks (one for 100 customers) and CSV files under one rule."""
    c = FX.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).cast("int").alias("b"), F.col("c_custkey").alias("编号"), F.col("c_name").alias("名称"),
                                                   F.col("c_acctbal").alias("余额"))
    folder = FX.fresh_dir(spark, "mixed")
    plain_workbooks(c.filter("b % 2 = 0"), f"{folder}/books", "b", "编号")
    FX.write_csv_folder(c.filter("b % 2 = 1").withColumn("余额", FX.money_text("余额")), f"{folder}/texts", ["b"], ["编号"])
    from ledgerloom.plans.workspace import Workspace
    ws = Workspace(spark)
    _, runs = quickstart(ws, folder, "mixed", "customers")
    bad = [r for r in runs if not r.ok]
    if bad:
        raise RuntimeError(bad[0].error)
    return ws.read(MASTER, "customers").select("编号", "名称", "余额", F.regexp_extract("__source_file", "\\.([a-z]+)$", 1).alias("kind"), "__source_row")


ORACLES["quickstart_workbook"] = f"""
SELECT CAST(c_custkey AS VARCHAR) AS "编号", c_name AS "名称", {_CENTS} AS "余额", CASE WHEN c_custkey // 100 % 2 = 0 THEN 'xlsx' ELSE 'csv' END AS kind,
  CAST(1 + row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS BIGINT) AS __source_row FROM customer"""


def sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: UPDATE as text, with a subquery over the table itself, and the rows it met."""
    ws, ns = _customers(spark, sf_dir)
    n = adhoc(ws, "UPDATE cust AS c SET balance = c.balance - 1, name = upper(name) WHERE c.nation IN (SELECT nation FROM cust WHERE balance > 999000) "
                  "AND segment <> 'BUILDING'", folder="客户").changes
    return ws.read(ns, "cust").select("key", "balance", "name", F.lit(n).alias("changed"))


_HIT = f"c_nationkey IN (SELECT c_nationkey FROM customer WHERE {_CENTS} > 999000) AND c_mktsegment <> 'BUILDING'"
ORACLES["sql_update"] = f"""
SELECT c_custkey AS key, {_CENTS} - CASE WHEN {_HIT} THEN 1 ELSE 0 END AS balance, CASE WHEN {_HIT} THEN upper(c_name) ELSE c_name END AS name,
  (SELECT COUNT(*) FROM customer WHERE {_HIT}) AS changed FROM customer"""


def sql_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: DELETE and INSERT as text; the counts of both."""
    ws, ns = _customers(spark, sf_dir)
    gone = adhoc(ws, "DELETE FROM cust WHERE balance < 0 OR segment = 'MACHINERY'", folder="客户").changes
    added = adhoc(ws, "INSERT INTO \"bt_客户\".cust (key, segment) SELECT -key, 'COPY' FROM cust WHERE nation = 1", folder="客户").changes
    return ws.read(ns, "cust").select("key", "segment", "balance", F.lit(gone).alias("deleted"), F.lit(added).alias("added"))


_KEPT = f"NOT ({_CENTS} < 0 OR c_mktsegment = 'MACHINERY')"
ORACLES["sql_delete"] = f"""
SELECT key, segment, balance, (SELECT COUNT(*) FROM customer WHERE NOT {_KEPT}) AS deleted, (SELECT COUNT(*) FROM customer WHERE {_KEPT} AND c_nationkey = 1) AS added FROM (
  SELECT c_custkey AS key, c_mktsegment AS segment, {_CENTS} AS balance FROM customer WHERE {_KEPT}
  UNION ALL SELECT -c_custkey, 'COPY', NULL FROM customer WHERE {_KEPT} AND c_nationkey = 1)"""

_EDGES = "SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity >= 45 UNION ALL SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity < 3"
_REACH = "SELECT n, COUNT(*) OVER () AS reached FROM reach"


def sql_recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION recursion over a graph with cycles that grows with the data (numbers of suppliers and parts linked by orders)."""
    ws = master_workspace(spark, sf_dir)
    return run_sql(ws, f"WITH RECURSIVE edges AS ({_EDGES}), reach(n) AS (SELECT 1 AS n UNION SELECT e.b FROM reach r JOIN edges e ON e.a = r.n) {_REACH}")


ORACLES["sql_recursive_union"] = f"""
WITH RECURSIVE edges AS (SELECT DISTINCT a, b FROM ({_EDGES})), reach(n) AS (SELECT CAST(1 AS BIGINT) AS n UNION SELECT e.b FROM reach r JOIN edges e ON e.a = r.n) {_REACH}"""


def sql_win_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame counted in groups of equal order dates."""
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("d"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return groups_frame(o, ["o_orderpriority"], ["d"], -2, 1, near=F.count("cents"), total=F.sum("cents")).select("o_orderkey", "near", "total")


ORACLES["sql_win_groups"] = """
SELECT o_orderkey, COUNT(*) OVER w AS near, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS total FROM orders
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"""
