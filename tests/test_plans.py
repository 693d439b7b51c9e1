import os

from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, CleanPipeline, QueryPipeline, SqlCleanPipeline
from ledgerloom.plans import adhoc as A
from ledgerloom.plans.export import write_csv
from ledgerloom.plans.impact import affected, build_graph, recompute_order, trigger_sources
from ledgerloom.plans.rebuild import Project, pipeline_order
from ledgerloom.plans.workspace import MASTER, Workspace


def test_graph_closure_and_order(spark, tmp):
    ps = [CleanPipeline("c1", "/d/seq", "seq"), QueryPipeline("q1", "SELECT 1", "r1", ["seq"]),
          QueryPipeline("q2", "SELECT 1", "r2", ["r1"])]
    nodes, edges = build_graph(spark, ps, [BigTableConfig("seq", "seq")])
    ids = {r["id"] for r in affected(edges, "src:/d/seq").collect()}
    assert ids == {"job:c1", "bt:seq", "job:q1", "job:q2"}
    order = [r["id"] for r in recompute_order(edges, "src:/d/seq").collect()]
    assert order == ["job:c1", "bt:seq", "job:q1", "job:q2"]
    assert [r["id"] for r in trigger_sources(nodes).collect()] == ["src:/d/seq"]


def test_pipeline_order_shuffled(spark, tmp):
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    ps = [QueryPipeline("q1", "SELECT 1", "r", ["seq"]), CleanPipeline("c1", "/d", "f"),
          SqlCleanPipeline("m1", ["f"], "SELECT 1", "seq")]
    assert pipeline_order(ws, Project(ps, [BigTableConfig("f", "t")])) == ["c1", "m1", "q1"]


def test_cycle_safe(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    assert {r["id"] for r in affected(edges, "a").collect()} == {"b", "c"}


def test_adhoc_cap(spark, tmp):
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    ws.write_table(spark.range(6000).select(F.col("id").alias("n")), MASTER, "big")
    r = A.adhoc(ws, "SELECT n FROM big ORDER BY n;")
    assert r.truncated and r.df.count() == 5000
    r = A.adhoc(ws, "SELECT n FROM big", limit=10)
    assert r.df.count() == 10 and r.truncated
    r = A.adhoc(ws, "SELECT n FROM big WHERE n < 3")
    assert not r.truncated and r.df.count() == 3


def test_csv_export_bytes(spark, tmp):
    df = spark.createDataFrame([("a,b", None, " x "), ('a"b', "", "l\nm")], "p string, q string, r string")
    out = os.path.join(tmp, "out")
    write_csv(df, out, single_file=True)
    part = [f for f in os.listdir(out) if f.endswith(".csv")][0]
    with open(os.path.join(out, part), encoding="utf-8") as fh:
        text = fh.read()
    assert text == 'p,q,r\n"a,b",, x \n"a""b",,"l\nm"\n'


def test_list_tables_local_and_uri_root(spark, tmp):
    for root in (os.path.join(tmp, "a"), "file://" + os.path.join(tmp, "b")):
        ws = Workspace(spark, root)
        ws.write_table(spark.createDataFrame([(1, "x")], "n bigint, s string"), MASTER, "t1")
        ws.write_table(spark.createDataFrame([(1.5,)], "d double"), MASTER, "t2")
        got = [tuple(r) for r in ws.list_tables(MASTER).collect()]
        assert got == [("t1", "n", "bigint", 0), ("t1", "s", "string", 1), ("t2", "d", "double", 0)], root
