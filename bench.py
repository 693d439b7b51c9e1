"""Benchmark: the three stages on data derived from the sf tables.

Prints ONE JSON line: {"metric", "value" (total seconds of the timed stages),
"unit", "queries" (seconds per stage), "rows", "rows_per_sec", "sf"}.
Fixture writing (deriving CSV / workbook folders from Parquet) and an untimed
warm-up pass on sf0.001 (JIT / codegen / Python workers; BENCH_WARMUP=0 turns
it off) are reported under "prep_sec" and are not part of the total.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import SparkSession

    from ledgerloom.session import configure
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("ledgerloom-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)

    from ledgerloom.config import QueryPipeline, SqlCleanPipeline
    from ledgerloom.plans.stages import run_query, sql_clean
    from ledgerloom.plans.adhoc import adhoc
    from ledgerloom.plans.workspace import Workspace
    from ledgerloom.suite import fixtures as FX
    from ledgerloom.suite.common import clean_folder
    from ledgerloom.suite.ingest import BUCKET_SQL, JOURNAL_RULE, JOURNAL_TABLE, MONEY_RULE, MONEY_TABLE
    from ledgerloom.suite.workbooks import WB_RULE, WB_TABLE
    from ledgerloom.suite.xlsx_fixture import orders_workbooks

    q, rows, prep = {}, {}, {}

    # Untimed warm-up on the smallest data set (JIT, code generation, Python
    # workers), as a long-lived cluster session would be; reported in "prep_sec".
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(warm_dir):
        t = time.time()
        wws = Workspace(spark)
        clean_folder(spark, FX.journal_folder(spark, warm_dir), [JOURNAL_RULE], JOURNAL_TABLE, wws)
        clean_folder(spark, orders_workbooks(spark, warm_dir), [WB_RULE], WB_TABLE, wws)
        sql_clean(wws, SqlCleanPipeline("w", ["门店账"], 'SELECT fen, "date" FROM "bt_门店账".entries', "entries"),
                  {"门店账": "entries"})
        run_query(wws, QueryPipeline("wq", BUCKET_SQL, "sizes", ["entries"]))
        prep["warmup_sf0.001"] = round(time.time() - t, 3)

    def timed(name, fn):
        t = time.time()
        out = fn()
        q[name] = round(time.time() - t, 3)
        return out

    t = time.time()
    journal = FX.journal_folder(spark, sf_dir)
    money = FX.lineitem_money_folder(spark, sf_dir)
    books = orders_workbooks(spark, sf_dir)
    prep["fixtures"] = round(time.time() - t, 3)

    ws = Workspace(spark)
    _, res, _ = timed("clean_orders_csv", lambda: clean_folder(spark, journal, [JOURNAL_RULE], JOURNAL_TABLE, ws))
    rows["clean_orders_csv"] = res.summary.rows
    _, res2, _ = timed("clean_lineitem_csv", lambda: clean_folder(spark, money, [MONEY_RULE], MONEY_TABLE, ws))
    rows["clean_lineitem_csv"] = res2.summary.rows
    _, res3, _ = timed("clean_orders_xlsx", lambda: clean_folder(spark, books, [WB_RULE], WB_TABLE, ws))
    rows["clean_orders_xlsx"] = res3.summary.rows
    s = timed("sql_clean", lambda: sql_clean(
        ws, SqlCleanPipeline("m1", ["money"], "SELECT orderkey, linenumber, price_cents, signed_cents "
                             'FROM "bt_money".amounts WHERE price_cents IS NOT NULL', "lines"),
        {"money": "amounts", "门店账": "entries"}))
    rows["sql_clean"] = s.rows
    sql_clean(ws, SqlCleanPipeline("m2", ["门店账"], 'SELECT fen, "date" FROM "bt_门店账".entries', "entries"),
              {"门店账": "entries"})
    b = timed("bucket_query", lambda: run_query(ws, QueryPipeline("qb", BUCKET_SQL, "sizes", ["entries"])))
    rows["bucket_query"] = rows["clean_orders_csv"]
    timed("adhoc_group", lambda: adhoc(
        ws, "SELECT l.orderkey, SUM(l.price_cents) AS c FROM master.lines l GROUP BY l.orderkey", capped=False).df.count())
    rows["adhoc_group"] = s.rows
    del b

    total = round(sum(q.values()), 3)
    rps = {k: round(rows[k] / q[k], 1) for k in rows if q.get(k)}
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": q, "rows": rows,
                      "rows_per_sec": rps, "prep_sec": prep, "sf": float(sf.group(1)) if sf else sf_dir,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
