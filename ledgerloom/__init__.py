"""ledgerloom: rule-driven consolidation of CSV / workbook folders into typed,
lineage-carrying tables, built on Spark DataFrames and Spark SQL.

Stages (all Spark jobs):
  clean      files x rules  -> one big table per folder (namespace ``bt_<slug>``)
  sql-clean  Spark SQL over big tables -> a table in the ``master`` namespace
  query      Spark SQL over master -> a materialised result table
"""

from ledgerloom.session import get_session, configure, work_dir

__all__ = ["get_session", "configure", "work_dir"]
