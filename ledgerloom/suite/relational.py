"""SQL-surface checks (D1-D27): user SQL through the query stage's parser
settings (double-quoted identifiers) over master tables attached to the given
Parquet data. Money is compared as integer cents, averages as an exact
division, so both engines produce identical values."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.statements import run_sql
from ledgerloom.plans.workspace import MASTER, Workspace
from ledgerloom.session import clone, work_dir

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_WS: dict[tuple, Workspace] = {}


def master_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """A workspace whose master namespace holds the given tables (attached, not copied)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    ws = _WS.get(key)
    if ws is None:
        ws = Workspace(spark)
        for t in TABLES:
            p = os.path.join(sf_dir, f"{t}.parquet")
            if os.path.exists(p) or "://" in p:
                ws.attach(MASTER, t, p)
        _WS[key] = ws
    return ws


# rows of a file of a spread table, and its least number of files
SPREAD_ROWS, SPREAD_FILES = 10_000, 64


def spread_workspace(spark: SparkSession, sf_dir: str, table: str) -> Workspace:
    """``master_workspace`` with a copy of ``table`` in many files, each read by a task of its own, for statements whose work for a
    row is long: tasks are cut by bytes, and few bytes would be one task."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
    path = work_dir(spark, "spread", fresh=True)
    df.repartition(max(SPREAD_FILES, -(-df.count() // SPREAD_ROWS))).write.parquet(path)
    own = clone(spark)
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    ws = Workspace(own)
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if t == table or os.path.exists(p) or "://" in p:
            ws.attach(MASTER, t, path if t == table else p)
    return ws


def spread_check(spark_sql: str, table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spread_workspace(spark, sf_dir, table), spark_sql)
    return run


def sql_check(spark_sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(master_workspace(spark, sf_dir), spark_sql)
    return run


CENTS = "CAST(round({x} * 100) AS BIGINT)"

# name -> (ids covered, Spark SQL, DuckDB SQL or None when identical)
CHECKS: dict[str, tuple[str, str, str | None]] = {
    "sql_projection": ("D1", """
SELECT c_custkey AS custkey, upper(c_name) AS name_u, c_nationkey AS nation,
       CAST(round(c_acctbal * 100) AS BIGINT) AS bal_cents, * EXCEPT (c_name, c_acctbal, c_custkey, c_nationkey)
FROM customer""", """
SELECT c_custkey AS custkey, upper(c_name) AS name_u, c_nationkey AS nation,
       CAST(round(c_acctbal * 100) AS BIGINT) AS bal_cents, * EXCLUDE (c_name, c_acctbal, c_custkey, c_nationkey)
FROM customer"""),
    "sql_filter": ("D2", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND NOT (1 = 0) AND o_orderpriority <> '5-LOW'""", None),
    "sql_group_agg": ("D3", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS sum_qty,
       SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS sum_cents
FROM lineitem GROUP BY l_returnflag, l_linestatus""", None),
    "sql_global_agg": ("D4", """
SELECT COUNT(*) AS n, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total_cents,
       MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship,
       (SELECT SUM(l_quantity) FROM lineitem WHERE l_quantity < 0) AS empty_sum
FROM lineitem""", None),
    "sql_other_aggs": ("D5", """
SELECT o_orderpriority,
       CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS avg_cents,
       MIN(o_orderdate) AS min_date, MAX(o_orderkey) AS max_key,
       COUNT(DISTINCT o_custkey) AS n_customers,
       COALESCE(SUM(CASE WHEN o_orderstatus = 'X' THEN 1 END), 0) AS total_x,
       COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
       SUM(DISTINCT o_custkey % 7) AS sum_distinct_mod
FROM orders GROUP BY o_orderpriority""", None),
    "sql_listagg": ("D5", """
SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""", """
SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""),
    "sql_having": ("D6", """
SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15""", None),
    "sql_topk": ("D8 D9", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""", None),
    "sql_limit_offset": ("D9", """
SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100""", None),
    "sql_join_inner": ("D10", """
SELECT n_name, COUNT(*) AS n_orders, SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""", None),
    "sql_join_left": ("D11", """
SELECT c_custkey, COUNT(o_orderkey) AS n_orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""", None),
    "sql_join_right": ("D11", """
SELECT s_suppkey, COUNT(ps.l_partkey) AS n_lines
FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 45) ps
RIGHT JOIN supplier ON ps.l_suppkey = s_suppkey GROUP BY s_suppkey""", None),
    "sql_join_full": ("D11", """
SELECT COALESCE(a.k, b.k) AS k, a.n_cust, b.n_supp FROM
 (SELECT c_nationkey AS k, COUNT(*) AS n_cust FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) a
 FULL OUTER JOIN
 (SELECT s_nationkey AS k, COUNT(*) AS n_supp FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b
 ON a.k = b.k""", None),
    "sql_join_using": ("D11", """
SELECT regionkey, n_name, r_name FROM
 (SELECT n_regionkey AS regionkey, n_name FROM nation) JOIN (SELECT r_regionkey AS regionkey, r_name FROM region)
 USING (regionkey)""", None),
    "sql_semi_anti": ("D12", """
SELECT c.c_custkey, a.k IS NOT NULL AS has_orders, f.k IS NULL AS no_f_orders
FROM customer c
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) a ON a.k = c.c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') f ON f.k = c.c_custkey""", """
SELECT c_custkey,
       EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders,
       c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS no_f_orders
FROM customer"""),
    "sql_semi_join": ("D12", """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)""", None),
    "sql_not_in": ("D12", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""", None),
    "sql_natural_join": ("D11", """
SELECT nk, n_name, n_suppliers FROM (SELECT n_nationkey AS nk, n_name FROM nation)
NATURAL JOIN (SELECT s_nationkey AS nk, COUNT(*) AS n_suppliers FROM supplier GROUP BY s_nationkey)""", None),
    # customers by the balance bands that hold them: bands of 500 are the join key, the range is the filter
    "sql_range_join": ("D13", """
WITH bands AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 400 AS hi FROM supplier),
cells AS (SELECT s_suppkey, lo, hi, explode(sequence(CAST(floor(lo / 500) AS INT), CAST(floor(hi / 500) AS INT))) AS cell FROM bands)
SELECT s_suppkey, COUNT(*) AS n_customers FROM cells
JOIN (SELECT c_acctbal, CAST(floor(c_acctbal / 500) AS INT) AS cell FROM customer) c USING (cell)
WHERE c_acctbal BETWEEN lo AND hi GROUP BY s_suppkey""", """
SELECT s_suppkey, COUNT(*) AS n_customers FROM supplier JOIN customer
  ON c_acctbal BETWEEN s_acctbal AND s_acctbal + 400 GROUP BY s_suppkey"""),
    "sql_union": ("D14", """
SELECT 'all' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'distinct', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""", None),
    "sql_intersect_except": ("D15", """
SELECT 'both' AS kind, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
                               INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL
SELECT 'f_only', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
                         EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""", None),
    "sql_distinct": ("D16", """
SELECT DISTINCT c_nationkey, c_mktsegment FROM customer""", None),
    "sql_cte": ("D17", """
WITH big AS (SELECT o_custkey, SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY o_custkey),
     ranked AS (SELECT c_mktsegment, cents FROM big JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, COUNT(*) AS n, MAX(cents) AS max_cents FROM ranked GROUP BY c_mktsegment""", None),
    "sql_recursive_cte": ("D18", """
WITH RECURSIVE chain(k, depth) AS (
  SELECT MIN(n_nationkey), 0 FROM nation
  UNION ALL
  SELECT n.n_nationkey, c.depth + 1 FROM chain c JOIN nation n ON n.n_nationkey = c.k + 5 WHERE c.depth < 10)
SELECT k, depth FROM chain""", None),
    "sql_subquery": ("D19", """
SELECT c_custkey, c_nationkey FROM customer c
WHERE c_acctbal > (SELECT AVG(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
  AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region))""", None),
    "sql_win_rank": ("D20", """
SELECT o_orderkey, o_custkey,
  ROW_NUMBER() OVER w AS rn, RANK() OVER w AS rnk, DENSE_RANK() OVER w AS drnk, NTILE(4) OVER w AS quart,
  PERCENT_RANK() OVER w AS prank, CUME_DIST() OVER w AS cdist
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey)""", None),
    "sql_win_lag": ("D21", """
SELECT o_orderkey, o_custkey,
  LAG(o_orderkey) OVER w AS prev_key, LEAD(o_orderkey, 2) OVER w AS next2_key,
  FIRST_VALUE(o_orderkey) OVER w AS first_key,
  LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key,
  NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", None),
    "sql_win_frame": ("D22", """
SELECT o_orderkey, o_custkey,
  SUM(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_cents,
  COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS n_near,
  SUM(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running_cents
FROM orders""", None),
    "sql_case": ("D23", """
SELECT o_orderkey,
  CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
  COALESCE(NULLIF(o_orderstatus, 'P'), 'pending') AS status,
  IF(o_orderpriority LIKE '1-%', 1, 0) AS urgent
FROM orders""", """
SELECT o_orderkey,
  CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
  COALESCE(NULLIF(o_orderstatus, 'P'), 'pending') AS status,
  IF(o_orderpriority LIKE '1-%', 1, 0) AS urgent
FROM orders"""),
    "sql_strings": ("D24", """
SELECT c_custkey, substr(c_name, 10) AS tail, trim('  ' || c_mktsegment || '  ') AS seg,
  replace(c_name, 'Customer', 'C') AS short, lower(c_mktsegment) AS lo, instr(c_name, '#') AS hash_pos,
  length(c_name) AS len, c_mktsegment || '/' || CAST(c_nationkey AS STRING) AS tag,
  printf('%s-%05d', c_mktsegment, c_custkey) AS code, c_name LIKE '%0001%' AS has_0001
FROM customer""", """
SELECT c_custkey, substr(c_name, 10) AS tail, trim('  ' || c_mktsegment || '  ') AS seg,
  replace(c_name, 'Customer', 'C') AS short, lower(c_mktsegment) AS lo, instr(c_name, '#') AS hash_pos,
  length(c_name) AS len, c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS tag,
  printf('%s-%05d', c_mktsegment, c_custkey) AS code, c_name LIKE '%0001%' AS has_0001
FROM customer"""),
    "sql_dates": ("D25", """
SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, year(o_orderdate) AS yr,
  datediff(DATE'2000-01-01', CAST(o_orderdate AS DATE)) AS days_to_2000,
  CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS plus30
FROM orders""", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) AS yr,
  datediff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days_to_2000,
  CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS plus30
FROM orders"""),
    "sql_math": ("D26", """
SELECT l_orderkey, l_linenumber, abs(CAST(round(l_extendedprice * (l_discount - 0.05) * 100) AS BIGINT)) AS abs_cents,
  round(CAST(l_quantity AS BIGINT) / 7) AS q7, least(l_linenumber, 3) AS lo, greatest(l_linenumber, 3) AS hi,
  l_orderkey % 10 AS last_digit
FROM lineitem""", """
SELECT l_orderkey, l_linenumber, abs(CAST(round(l_extendedprice * (l_discount - 0.05) * 100) AS BIGINT)) AS abs_cents,
  round(CAST(l_quantity AS BIGINT) / 7) AS q7, least(l_linenumber, 3) AS lo, greatest(l_linenumber, 3) AS hi,
  l_orderkey % 10 AS last_digit
FROM lineitem"""),
    "sql_json": ("D27", """
SELECT event_id, event_type, CAST(get_json_object(props, '$.k') AS INT) AS k
FROM events""", """
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events"""),
}

ORACLES: dict[str, str] = {}
FUNCS = {}
for _name, (_ids, _spark, _duck) in CHECKS.items():
    # each customer is tested against all suppliers of its band
    FUNCS[_name] = spread_check(_spark.strip(), "customer") if _name == "sql_range_join" else sql_check(_spark.strip())
    ORACLES[_name] = (_duck or _spark).strip()
