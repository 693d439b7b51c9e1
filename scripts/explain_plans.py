"""Print the physical plans of the main stages (formatted), to check pushdown,
column pruning and join strategies.

usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    from ledgerloom.config import SqlCleanPipeline
    from ledgerloom.plans.stages import sql_clean
    from ledgerloom.plans.statements import run_sql
    from ledgerloom.plans.workspace import Workspace
    from ledgerloom.session import get_session
    from ledgerloom.suite import fixtures as FX
    from ledgerloom.suite.common import clean_folder
    from ledgerloom.suite.ingest import BUCKET_SQL, JOURNAL_RULE, JOURNAL_TABLE
    from ledgerloom.suite.relational import master_workspace

    spark = get_session("local[8]")
    ws = Workspace(spark)
    _, res, big = clean_folder(spark, FX.journal_folder(spark, sf_dir), [JOURNAL_RULE], JOURNAL_TABLE, ws)
    sql_clean(ws, SqlCleanPipeline("m1", ["门店账"], 'SELECT fen, "date" FROM "bt_门店账".entries', "entries"),
              {"门店账": "entries"})

    print("== stored big table: filter + projection (expect PushedFilters, narrow ReadSchema)")
    big.filter(F.col("note") == "1-URGENT").select("order_key", "date").explain("formatted")

    print("== flagship bucket query over master.entries")
    run_sql(ws, BUCKET_SQL).explain("formatted")

    print("== join over attached tables (broadcast of the small side, partial aggregation)")
    mws = master_workspace(spark, sf_dir)
    run_sql(mws, "SELECT n_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey "
                 "JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name"
            ).explain("formatted")


if __name__ == "__main__":
    main()
