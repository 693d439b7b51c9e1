"""Checks of exact edges: byte order marks and blank records, 64-bit integers, updates of
their own condition, reopened workspaces, configuration graphs and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, BigTableField, CleanPipeline, QueryPipeline, Rule, RuleField, RuleSource, SqlCleanPipeline
from ledgerloom.plans import impact
from ledgerloom.plans.stages import run_query, sql_clean
from ledgerloom.plans.workspace import Workspace
from ledgerloom.sources.csvrows import csv_raw_rows
from ledgerloom.suite import fixtures as FX
from ledgerloom.suite.common import clean_folder
from ledgerloom.suite.ingest import JOURNAL_RULE, JOURNAL_TABLE
from ledgerloom.suite.workflow import _customers

ORACLES: dict[str, str] = {}


def csv_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: files that begin with a byte order mark (blank records at the end: ``tests/test_csv.py``)."""
    s = FX.table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 100).cast("int").alias("b"), "s_suppkey", "s_name")
    lines = s.select("b", F.col("s_suppkey").alias("o"), F.concat_ws(",", "s_suppkey", "s_name").alias("value"))
    head = s.select("b").distinct().select("b", F.lit(-1).cast("long").alias("o"), F.lit("\ufeffkey,name").alias("value"))
    out = FX.fresh_dir(spark, "bom")
    # a CSV of one column, unquoted: the lines as they are
    (lines.unionByName(head).repartition("b").sortWithinPartitions("b", "o").select("b", "value")
     .write.options(header="false", quote="", sep="\u0002").partitionBy("b").csv(out))
    raw = csv_raw_rows(spark, out)
    return raw.select(F.regexp_extract("source_file", "/b=([0-9]+)/", 1).cast("int").alias("b"), "row_no",
                      F.get("cells", 0).alias("first_cell"), F.size("cells").alias("n_cells"))


ORACLES["csv_bom"] = """
WITH s AS (SELECT CAST(floor(s_suppkey / 100) AS INTEGER) AS b, s_suppkey AS k FROM supplier)
SELECT b, CAST(1 + row_number() OVER (PARTITION BY b ORDER BY k) AS BIGINT) AS row_no, CAST(k AS VARCHAR) AS first_cell, 2 AS n_cells FROM s
UNION ALL SELECT b, 1, 'key', 2 FROM s GROUP BY b"""


def exact_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits keep their value over the whole 64-bit range; fractions are rejected."""
    o = FX.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prio"), F.col("o_orderkey").alias("k"))
    text = o.select("prio", F.col("k").cast("string").alias("key"), (F.lit(9007199254740993) + F.col("k")).cast("string").alias("wide"),
                    (F.lit(-9223372036854775807) + F.col("k")).cast("string").alias("low"),
                    F.concat(F.col("k"), F.lit(".0")).alias("point"), F.concat(F.col("k"), F.lit(".5")).alias("half"))
    folder = FX.write_csv_folder(text, FX.fresh_dir(spark, "integers"), ["prio"], [F.col("key").cast("long")])
    names = ("key", "wide", "low", "point", "half")
    rule = Rule("integers", [RuleSource("**/*.csv", 1)], [RuleField(n, n, i) for i, n in enumerate(names)])
    _, res, df = clean_folder(spark, folder, [rule], BigTableConfig("integers", "t", [BigTableField(n, "INTEGER") for n in names]))
    return df.select(*names, F.lit(res.rejects["half"]).alias("rejected"))


ORACLES["exact_integers"] = """
SELECT o_orderkey AS key, 9007199254740993 + o_orderkey AS wide, -9223372036854775807 + o_orderkey AS low, o_orderkey AS point,
  CAST(NULL AS BIGINT) AS half, (SELECT COUNT(*) FROM orders) AS rejected FROM orders"""


def update_own_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: an UPDATE of the column it filters on reports the rows it met."""
    ws, ns = _customers(spark, sf_dir)
    n = ws.update_where(ns, "cust", "segment = 'BUILDING'", {"segment": "'BUILT'"})
    return ws.read(ns, "cust").select("key", "segment", F.lit(n).alias("changed"))


ORACLES["update_own_condition"] = """
SELECT c_custkey AS key, replace(c_mktsegment, 'BUILDING', 'BUILT') AS segment,
  (SELECT COUNT(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS changed FROM customer"""


def reopen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: a workspace opened again knows its tables by their display names."""
    ws, _, _ = clean_folder(spark, FX.journal_folder(spark, sf_dir), [JOURNAL_RULE], JOURNAL_TABLE)
    sql_clean(ws, SqlCleanPipeline("m", ["门店账"], 'SELECT note, order_key FROM "bt_门店账".entries', "明细"), {"门店账": "entries"})
    Workspace(spark).write_table(spark.range(1), "master", "明细")     # another workspace has a table of this name
    again = Workspace(spark, ws.root)
    run_query(again, QueryPipeline("q", 'SELECT note, COUNT(*) AS n FROM "明细" GROUP BY note', "counts", ["明细"]))
    return again.read("master", "counts")


ORACLES["reopen_query"] = "SELECT o_orderpriority AS note, COUNT(*) AS n FROM orders GROUP BY 1"


def pipeline_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and trigger sources of a clean per nation, a sql-clean and a query per region."""
    rows = FX.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()     # configuration
    tables = [BigTableConfig(f"n{k}", f"t{k}", []) for k, _ in rows]
    jobs = [CleanPipeline(f"c{k}", f"/in/{k}", f"n{k}") for k, _ in rows]
    for r in sorted({r for _, r in rows}):
        jobs.append(SqlCleanPipeline(f"s{r}", [f"n{k}" for k, x in rows if x == r], "SELECT 1", f"m{r}"))
        jobs.append(QueryPipeline(f"q{r}", "SELECT 1", f"r{r}", [f"m{r}"]))
    nodes, edges = impact.build_graph(spark, jobs, tables)
    triggers = impact.trigger_sources(nodes).withColumn("trigger", F.lit(True))
    return edges.join(triggers.withColumnRenamed("id", "src"), "src", "left").select("src", "dst", F.coalesce("trigger", F.lit(False)).alias("trigger"))


ORACLES["pipeline_graph"] = """
SELECT 'src:/in/' || n_nationkey AS src, 'job:c' || n_nationkey AS dst, true AS trigger FROM nation
UNION ALL SELECT 'job:c' || n_nationkey, 'bt:t' || n_nationkey, false FROM nation
UNION ALL SELECT 'bt:t' || n_nationkey, 'job:s' || n_regionkey, false FROM nation
UNION ALL SELECT DISTINCT 'job:s' || n_regionkey, 'job:q' || n_regionkey, false FROM nation"""


def order_with_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers; the customers of region 0 lead back to their nation."""
    n = FX.table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("r"), F.concat(F.lit("N"), "n_nationkey").alias("n"), "n_nationkey", "n_regionkey")
    c = FX.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n", F.concat(F.lit("C"), "c_custkey").alias("c"), "n_regionkey")
    edges = (n.select(F.lit("S").alias("src"), F.col("r").alias("dst")).distinct().unionByName(n.select(F.col("r").alias("src"), F.col("n").alias("dst")))
             .unionByName(c.select(F.col("n").alias("src"), F.col("c").alias("dst")))
             .unionByName(c.filter("n_regionkey = 0").select(F.col("c").alias("src"), F.col("n").alias("dst"))))
    return impact.recompute_order(edges, "S").select("id", "level")


ORACLES["order_with_cycle"] = """
SELECT DISTINCT 'R' || n_regionkey AS id, 1 AS level FROM nation
UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_regionkey = 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) THEN NULL ELSE 2 END FROM nation
UNION ALL SELECT 'C' || c_custkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE 3 END FROM customer JOIN nation ON c_nationkey = n_nationkey"""
