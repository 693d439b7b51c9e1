"""Statements on workspaces: names, isolation, guards, changes, commits."""
import os

import pytest

from ledgerloom.config import ConfigError, SqlCleanPipeline
from ledgerloom.plans.adhoc import adhoc
from ledgerloom.plans.export import export_query
from ledgerloom.plans.stages import sql_clean
from ledgerloom.plans.statements import Scope, parsed, run_sql
from ledgerloom.plans.workspace import MASTER, ConcurrentWriteError, TableMissingError, Workspace, bt_namespace


def _ws(spark, tmp, name, **tables):
    ws = Workspace(spark, os.path.join(tmp, name))
    for t, rows in tables.items():
        ws.write_table(spark.createDataFrame(rows, "k bigint, s string"), MASTER, t)
    return ws


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_workspaces_in_turn(spark, tmp):
    a, b = _ws(spark, tmp, "a", t=[(1, "a")]), _ws(spark, tmp, "b", t=[(2, "b")])
    first = run_sql(a, "SELECT * FROM t")
    for _ in range(2):
        assert _rows(run_sql(b, "SELECT * FROM master.t")) == [(2, "b")]
        assert _rows(run_sql(a, 'SELECT x.k, x.s FROM "t" x')) == [(1, "a")]
    assert _rows(first) == [(1, "a")]
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        run_sql(_ws(spark, tmp, "c"), "SELECT * FROM t").collect()
    assert [r.namespace for r in spark.sql("SHOW DATABASES").collect()] == ["default"]


def test_names(spark, tmp):
    ws = _ws(spark, tmp, "a", 明细=[(1, "x"), (2, "y")], t=[(1, "t")])
    ws.write_table(spark.createDataFrame([(1, 10)], "k bigint, v bigint"), bt_namespace("序时账"), "seq")
    ws.write_table(spark.createDataFrame([(1, 11)], "k bigint, v bigint"), bt_namespace("other"), "seq")
    got = run_sql(ws, 'SELECT "明细".s, seq.v, master.t.s AS u FROM "明细" JOIN "bt_序时账".seq ON "明细".k = seq.k JOIN master.t ON t.k = seq.k '
                      "WHERE '\"明细\" 😀' <> '' -- FROM \"明细\"", folders=["序时账"])
    assert _rows(got) == [("x", 10, "t")]
    cte = 'WITH t AS (SELECT 5 AS k), u AS (SELECT k FROM t) SELECT u.k, (SELECT max(k) FROM "明细") AS m FROM u WHERE EXISTS (SELECT 1 FROM master.t WHERE t.k = 1)'
    assert _rows(run_sql(ws, cte)) == [(5, 2)]
    with pytest.raises(Exception, match="NOT_FOUND"):                     # not listed, not visible
        run_sql(ws, "SELECT * FROM bt_other.seq", folders=["序时账"])
    text, views = Scope(ws).resolve(parsed(spark, "SELECT '😀', k FROM master . \"明细\" WHERE k IN (SELECT k FROM t)"))
    assert sorted(v[1] for v in views.values()) == ["t", ws.slugs(MASTER)[1]] and "AS `明细`" in text
    spark.range(3).createOrReplaceTempView("own_view")                      # the user's views are seen, settings stay
    assert run_sql(ws, "SELECT * FROM own_view").count() == 3
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"
    spark.catalog.dropTempView("own_view")


def test_export_is_of_this_workspace_and_reads_only(spark, tmp):
    a, b = _ws(spark, tmp, "a", 表=[(1, "a")]), _ws(spark, tmp, "b", 表=[(2, "b")])
    out = os.path.join(tmp, "out")
    export_query(a, 'SELECT k, s FROM "表"', out)
    assert _rows(spark.read.csv(out, header=True)) == [("1", "a")]
    for sql in ('WITH c AS (SELECT 3 AS k, \'c\' AS s) INSERT INTO "表" SELECT * FROM c', "DROP TABLE t", "SELECT 1; DELETE FROM t"):
        with pytest.raises(Exception):
            export_query(a, sql, os.path.join(tmp, "none"))
    with pytest.raises(ConfigError):
        sql_clean(a, SqlCleanPipeline("m", [], 'WITH c AS (SELECT 1) INSERT INTO "表" SELECT 1, \'x\'', "r"), {})
    assert _rows(a.read(MASTER, "表")) == [(1, "a")] and _rows(b.read(MASTER, "表")) == [(2, "b")]


def test_insert_leaves_attached_data_alone(spark, tmp):
    path = os.path.join(tmp, "outside")
    spark.createDataFrame([(1, "a")], "k bigint, s string").write.parquet(path)
    before = sorted(os.listdir(path))
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    ws.attach(MASTER, "e", path)
    assert adhoc(ws, "INSERT INTO e VALUES (2, 'b'), (3, 'c')").changes == 2
    assert adhoc(ws, "WITH c AS (SELECT 4 AS n) INSERT INTO master.e (k) SELECT n FROM c").changes == 1
    assert adhoc(ws, "UPDATE e SET s = s || '!' WHERE k = 1").changes == 1
    assert _rows(ws.read(MASTER, "e").na.fill("-")) == [(1, "a!"), (2, "b"), (3, "c"), (4, "-")]
    assert sorted(os.listdir(path)) == before
    assert adhoc(ws, "INSERT OVERWRITE e SELECT 9, 'z'").changes == 1
    assert _rows(ws.read(MASTER, "e")) == [(9, "z")]
    with pytest.raises(ConfigError):
        adhoc(ws, "INSERT INTO e VALUES (1)")
    with pytest.raises(ConfigError):
        adhoc(ws, "DROP TABLE e")
    with pytest.raises(TableMissingError):
        adhoc(ws, "DELETE FROM nothing")


def test_update_and_delete_rewrite_only_files_with_hits(spark, tmp):
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    ws.write_table(spark.range(40).selectExpr("id AS k", "CAST(id % 4 AS STRING) AS s").repartitionByRange(4, "k"), MASTER, "t")
    ws.write_table(spark.createDataFrame([(39, "x")], "k bigint, s string"), MASTER, "pick")
    files = lambda: {f for p in ws.current(MASTER, "t").parts for f in ws.store.data_files(p)}
    before = files()
    assert len(before) == 4
    assert adhoc(ws, "UPDATE master.t AS x SET s = (SELECT max(s) FROM pick), k = x.k + 100 WHERE x.k < 3").changes == 3
    assert len(before & files()) == 3
    assert adhoc(ws, "DELETE FROM t WHERE k IN (SELECT k FROM pick) OR s IS NULL").changes == 1
    assert len(before & files()) == 2
    kept = files()
    assert adhoc(ws, "DELETE FROM t WHERE k = -1").changes == 0 and files() == kept
    got = dict(_rows(ws.read(MASTER, "t").select("k", "s")))
    assert len(got) == 39 and [got[100], got[101], got[102]] == ["x"] * 3 and 39 not in got and got[38] == "2"
    assert adhoc(ws, "UPDATE t SET s = NULL WHERE s = 'x' OR NULL").changes == 3
    assert adhoc(ws, "DELETE FROM t").changes == 39 and ws.read(MASTER, "t").count() == 0
    with pytest.raises(ConfigError):
        adhoc(ws, "UPDATE t SET nothing = 1")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_commits(spark, tmp, scheme, monkeypatch):
    """Versions on a path and on a URI root: reopened, a failure between write and commit, another writer, vacuum."""
    ws = _ws(spark, scheme + tmp, "ws", 表=[(1, "a")])
    monkeypatch.setattr(ws.store, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    for change in (lambda: ws.append(spark.createDataFrame([(2, "b")], "k bigint, s string"), MASTER, "表"), lambda: ws.delete_where(MASTER, "表", "k = 1")):
        with pytest.raises(RuntimeError, match="lost"):
            change()
    monkeypatch.undo()
    again = Workspace(spark, ws.root)
    assert _rows(run_sql(again, 'SELECT * FROM "表"')) == [(1, "a")] and [r.table for r in again.list_tables(MASTER).collect()] == ["表"] * 2
    assert again.append(spark.createDataFrame([(2, "b", 0.5)], "k bigint, s string, d double"), MASTER, "表") == 1
    assert ws.append(spark.createDataFrame([(3.5,)], "k double"), MASTER, "表") == 1       # written anew in the common type
    assert _rows(ws.read(MASTER, "表").na.fill("").na.fill(0.0)) == [(1.0, "a", 0.0), (2.0, "b", 0.5), (3.5, "", 0.0)]

    write, busy = ws._write, []

    def other(*a):
        if not busy:
            busy.append(1)
            again.append(spark.createDataFrame([(9.0, "z")], "k double, s string"), MASTER, "表")
        return write(*a)
    monkeypatch.setattr(ws, "_write", other)
    with pytest.raises(ConcurrentWriteError):
        ws.delete_where(MASTER, "表", "k = 1")
    monkeypatch.undo()
    assert ws.delete_where(MASTER, "表", "k = 1") == 1
    assert [v.number for v in ws.versions(MASTER, "表")] == [1, 2, 3, 4, 5]
    rows = _rows(ws.read(MASTER, "表").na.fill(""))
    assert ws.vacuum(MASTER, "表", keep=1) >= 2 and len(ws.versions(MASTER, "表")) == 1
    assert _rows(ws.read(MASTER, "表").na.fill("")) == rows and ws.vacuum(MASTER, "表", keep=1) == 0


def test_a_stream_batch_is_appended_once(spark, tmp):
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    df = spark.createDataFrame([(1,)], "k bigint")
    for n in (0, 0, 1, 1):
        if not ws.appended(MASTER, "t", ("q", n)):
            ws.append_observed(df, MASTER, "t", batch=("q", n))
    ws.append_observed(df, MASTER, "t", batch=("q", 1))              # a second driver that did not look
    assert ws.read(MASTER, "t").count() == 2
    ws.append_observed(df, MASTER, "t", batch=("other", 0))
    assert ws.read(MASTER, "t").count() == 3


def test_range_join_is_dealt_to_many_tasks(spark, tmp):
    """Few customers of few bytes, each tested against the suppliers of its band: one task before."""
    from ledgerloom.suite.relational import FUNCS
    spark.range(300).selectExpr("id AS s_suppkey", "CAST(id * 7 % 900 AS DOUBLE) AS s_acctbal").coalesce(1).write.parquet(f"{tmp}/supplier.parquet")
    spark.range(2000).selectExpr("id AS c_custkey", "CAST(id * 13 % 1500 AS DOUBLE) AS c_acctbal").coalesce(1).write.parquet(f"{tmp}/customer.parquet")
    got = FUNCS["sql_range_join"](spark, tmp)
    balances = [i * 13 % 1500 for i in range(2000)]
    assert {r.s_suppkey: r.n_customers for r in got.collect()} == {i: sum(i * 7 % 900 <= b <= i * 7 % 900 + 400 for b in balances) for i in range(300)}
    plan = got._jdf.queryExecution().sparkPlan()
    tasks = [plan.collectLeaves().apply(k).execute().getNumPartitions() for k in range(plan.collectLeaves().size())]
    assert max(tasks) == 64
