"""End-to-end clean / sql-clean / query on small CSV folders (F1-F5 layouts)."""

import os

import pytest

from ledgerloom.config import (BigTableConfig, BigTableField, CleanPipeline, ConfigError, QueryPipeline, Rule,
                               RuleField, RuleSource, SqlCleanPipeline, load_rules, save_rule)
from ledgerloom.operators.clean import clean
from ledgerloom.operators.headers import DuplicateHeaderError
from ledgerloom.plans.stages import NotCleanedError, run_query, sql_clean
from ledgerloom.plans.workspace import MASTER, Workspace, bt_namespace

RF = RuleField


def _write(d, name, text):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return p


def test_three_stages(spark, tmp):
    src = os.path.join(tmp, "src")
    _write(src, "a.csv", "日期,借方金额,摘要\n2024-01-15,123.45,工资\n2024/2/20,100,报销\n")
    _write(src, "sub/b.csv", "日期,借方金额\n2024-01,200\n")
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    rule = Rule("r", [RuleSource("**/*.csv", 1)], [RF("日期", "date", 0, True, ["coerce_date"]),
                                                  RF("借方金额", "debit", 1, True, ["coerce_cents"])])
    cfg = BigTableConfig("序时账", "seq", [BigTableField("debit", "INTEGER")])
    res = clean(ws, CleanPipeline("c1", src, "序时账"), [rule], cfg, extracted_at="2024-01-01T00:00:00.000Z")
    assert res.summary.rows == 3 and res.summary.files == 2
    assert res.summary.unused_headers == ["摘要"]
    rows = {r["debit"]: r for r in ws.read(res.namespace, "seq").collect()}
    assert rows[12345]["date"] == "2024-01-15" and rows[12345]["__source_row"] == 2
    assert rows[12345]["__source_sheet"] == "csv" and rows[10000]["date"] == "2024-02-20"
    assert rows[20000]["date"] == "2024-01"
    s = sql_clean(ws, SqlCleanPipeline("m1", ["序时账"], 'SELECT "date", debit FROM "bt_序时账".seq', "seq"),
                  {"序时账": "seq"})
    assert s.rows == 3
    q = run_query(ws, QueryPipeline("q1", "SELECT SUM(debit) AS total FROM seq", "total", ["seq"]))
    assert q.rows == 1 and ws.read(MASTER, "total").first()["total"] == 42345
    # a query may read and replace its own result table (staged write)
    run_query(ws, QueryPipeline("q2", "SELECT total * 2 AS total FROM total", "total", ["total"]))
    assert ws.read(MASTER, "total").first()["total"] == 84690
    # smaller rule -> the rebuilt table loses the column
    rule2 = Rule("r", [RuleSource("**/*.csv", 1)], [RF("借方金额", "debit", 0, True, ["coerce_cents"])])
    res2 = clean(ws, CleanPipeline("c1", src, "序时账"), [rule2], cfg)
    assert "date" not in ws.read(res2.namespace, "seq").columns


def test_repeated_headers(spark, tmp):
    src = os.path.join(tmp, "src")
    _write(src, "p.csv", "联系人,加入日,联系人,编码,联系人,分组\n,1990-01-01,甲,A1,,x\n,1991-02-02,乙,A2,,y\n")
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    bare = Rule("r", [RuleSource("*.csv", 1)], [RF("联系人", "name", 0)])
    with pytest.raises(DuplicateHeaderError):
        clean(ws, CleanPipeline("c", src, "p"), [bare], BigTableConfig("p", "t"))
    numbered = Rule("r", [RuleSource("*.csv", 1)], [RF("联系人_2", "name", 0)])
    res = clean(ws, CleanPipeline("c", src, "p"), [numbered], BigTableConfig("p", "t"))
    assert sorted(r["name"] for r in ws.read(res.namespace, "t").collect()) == ["乙", "甲"]


def test_errors(spark, tmp):
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    with pytest.raises(ConfigError) as e:
        clean(ws, CleanPipeline("c", os.path.join(tmp, "none"), "x"), [], BigTableConfig("x", "t"))
    assert e.value.code == "CLEAN_NO_FILES"
    with pytest.raises(ConfigError) as e:
        sql_clean(ws, SqlCleanPipeline("m", ["x"], "DELETE FROM t", "r"), {"x": "t"})
    assert e.value.code == "SQL_NOT_READONLY"
    with pytest.raises(NotCleanedError):
        sql_clean(ws, SqlCleanPipeline("m", ["x"], "SELECT 1", "r"), {"x": "t"})
    with pytest.raises(ConfigError) as e:
        run_query(ws, QueryPipeline("q", "SELECT 1", "", []))
    assert e.value.code == "RESULT_TABLE_REQUIRED"


def test_rule_yaml_roundtrip(tmp):
    r = Rule("b", [RuleSource("**/*.csv", 2, sheet_name="S")], [RF("a", "x", 1, True, ["coerce_cents"]),
                                                               RF("b", "y", 0, False, [])])
    save_rule(tmp, r, "2.yaml")
    save_rule(tmp, Rule("a", [RuleSource("*.csv")], [RF("c", "z", 0)]), "1.yml")
    rules = load_rules(tmp)
    assert [x.name for x in rules] == ["a", "b"]
    assert rules[1].sources[0].header_row == 2 and rules[1].fields[0].transforms == ["coerce_cents"]


def test_update_delete_append(spark, tmp):
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n bigint, s string")
    ws.write_table(df, MASTER, "t")
    assert ws.update_where(MASTER, "t", "n >= 2", {"s": "'z'"}) == 2
    assert ws.delete_where(MASTER, "t", "n = 1") == 1
    assert ws.append(spark.createDataFrame([(4, "d")], "n bigint, s string"), MASTER, "t") == 1
    assert sorted(tuple(r) for r in ws.read(MASTER, "t").collect()) == [(2, "z"), (3, "z"), (4, "d")]


def test_odd_file_names(spark, tmp):
    src = os.path.join(tmp, "src")
    _write(src, "a[1] x.csv", "k,v\n1,10\n2,20\n")
    _write(src, "b{2}+.CSV", "k,v\n3,30\n")
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    rule = Rule("r", [RuleSource("**/*", 1)], [RF("k", "k", 0), RF("v", "v", 1, True, ["coerce_cents"])])
    res = clean(ws, CleanPipeline("c", src, "odd"), [rule], BigTableConfig("odd", "t", [BigTableField("k", "INTEGER")]))
    got = sorted((r["k"], r["v"], r["__source_row"], r["__source_file"].rsplit("/", 1)[-1])
                 for r in ws.read(res.namespace, "t").collect())
    assert got == [(1, "1000", 2, "a[1] x.csv"), (2, "2000", 3, "a[1] x.csv"), (3, "3000", 2, "b{2}+.CSV")]
