"""Files and values that cannot be used are reported, the rest loads."""
import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, BigTableField, CleanPipeline, Rule, RuleField, RuleSource
from ledgerloom.operators import clean as C
from ledgerloom.plans.export import write_csv
from ledgerloom.plans.workspace import Workspace
from ledgerloom.sources import workbook
from ledgerloom.suite.xlsx_fixture import _Book

RULE = Rule("r", [RuleSource("**/*", 1)], [RuleField("k", "k", 0), RuleField("amt", "c", 1, True, ["coerce_cents"]), RuleField("n", "n", 2)])
CFG = BigTableConfig("q", "t", [BigTableField("k", "TEXT"), BigTableField("c", "INTEGER"), BigTableField("n", "REAL")])


def _write(d, name, data):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "wb") as fh:
        fh.write(data if isinstance(data, bytes) else data.encode())


def _clean(spark, tmp, src, **more):
    ws = Workspace(spark, os.path.join(tmp, f"ws{len(os.listdir(tmp))}"))
    res = C.clean(ws, CleanPipeline("c", src, "q"), [RULE], CFG, **more)
    return ws.read(res.namespace, res.table), res


def test_csv_files(spark, tmp):
    src = os.path.join(tmp, "src")
    _write(src, "good.csv", "k,amt,n\na,1.50,2\nb,x,3\n")
    _write(src, "bytes.csv", b"k,amt,n\nc\xff\xfe,2,1\n")
    _write(src, "open.csv", 'k,amt,n\nd,3,1\n"e,4,1\n')
    _write(src, "empty.csv", "")
    # a file whose stored checksum does not fit: reading it fails midway
    spark.range(2000).selectExpr("concat(id, ',1,1') AS value").coalesce(1).write.text(os.path.join(tmp, "made"))
    made = [f for f in os.listdir(os.path.join(tmp, "made")) if f.startswith("part")][0]
    data = bytearray(open(os.path.join(tmp, "made", made), "rb").read())
    data[len(data) // 2] ^= 1
    _write(src, "broken.csv", bytes(data))
    crc = open(os.path.join(tmp, "made", f".{made}.crc"), "rb").read()
    _write(src, ".broken.csv.crc", crc)
    df, res = _clean(spark, tmp, src)
    assert sorted((r["k"], r["c"]) for r in df.collect()) == [("a", 150), ("b", None), ("c��", 200), ("d", 300), ("e,4,1\n", None)]
    got = sorted((r["path"].rsplit("/", 1)[-1], r["problem"], r["skipped"], r["n"]) for r in res.rejected_files.collect())
    assert [g[:3] for g in got] == [("broken.csv", "not all bytes could be read", True), ("bytes.csv", "bytes that are no UTF-8", False), ("open.csv", "ends inside quotes", False)]
    assert sum(w.startswith("skipped unreadable file broken.csv") for w in res.summary.warnings) == 1


def test_notes_are_bounded(spark, tmp, monkeypatch):
    monkeypatch.setattr(C, "NOTED_FILES", 2)
    src = os.path.join(tmp, "src")
    for k in range(5):
        _write(src, f"{k}.xlsx", b"no zip")
    _write(src, "a.csv", "k,amt,n\na,1,1\n")
    df, res = _clean(spark, tmp, src)
    assert df.count() == 1 and res.rejected_files.filter("skipped").count() == 5
    assert [w.split(" ")[0] for w in res.summary.warnings] == ["skipped", "skipped", "5"]


def test_workbooks_that_no_rule_names_are_not_read(spark, tmp, monkeypatch):
    b = _Book()
    b.sheet("S", "A1:B2", [(1, ['<c r="A1" t="inlineStr"><is><t>k</t></is></c>', '<c r="B1" t="inlineStr"><is><t>amt</t></is></c>']),
                           (2, ['<c r="A2" t="inlineStr"><is><t>a</t></is></c>', '<c r="B2"><v>1.5</v></c>'])])
    src = os.path.join(tmp, "src dir+1")
    _write(src, "in é.xlsx", b.bytes())
    _write(os.path.join(src, "other"), "out.xlsx", b"no zip")
    _write(src, "~$in é.xlsx", b"lock file")
    monkeypatch.setattr(C, "now_iso", lambda: "t")
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    res = C.clean(ws, CleanPipeline("c", src, "q"), [Rule("r", [RuleSource("*.xlsx", 1)], RULE.fields)], CFG)
    assert [(r["k"], r["c"]) for r in ws.read(res.namespace, "t").collect()] == [("a", 150)] and res.rejected_files.count() == 0
    monkeypatch.setattr(workbook, "MAX_WORKBOOK_BYTES", 10)
    df, res = _clean(spark, tmp, src)
    assert df.count() == 0 and {r["problem"] for r in res.rejected_files.collect()} == {"a workbook of more than 10 bytes", "BadZipFile: File is not a zip file"}


def _scan_rows(df):
    """The rows that the Parquet scans of a collected DataFrame put out."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))
    walk(plan)
    return sum(found)


@pytest.mark.parametrize("quoted", [False, True])
def test_source_rows_reads_only_their_places(spark, tmp, quoted):
    src = os.path.join(tmp, "src")
    for f in range(6):
        _write(src, f"{f}.csv", "k,amt,n\n" + "".join(f"{f}-{k},{k}.00,1\n" if not quoted or k % 50 else f'"{f}-{k}\n",{k}.00,1\n' for k in range(400)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "1000")
    try:
        df, res = _clean(spark, tmp, src)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    page = df.filter("k IN ('0-7', '3-399', '5-0')" if not quoted else "k IN ('0-7', '3-399', '5-0\n')")
    got = C.source_rows(res, page)
    rows = {(r["source_file"].rsplit("/", 1)[-1], r["row_no"]): list(r["cells"]) for r in got.collect()}
    if not quoted:
        assert rows == {("0.csv", 9): ["0-7", "7.00", "1"], ("3.csv", 401): ["3-399", "399.00", "1"], ("5.csv", 2): ["5-0", "0.00", "1"]}
        assert "PushedFilters: [In(lid" in _plan(got)
        assert _scan_rows(got) < 6 * 400 / 4
    assert sorted(x[0] for x in rows.values()) == sorted(r["k"] for r in page.collect())
    assert C.source_rows(res, df.limit(0)).collect() == []


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_single_file_is_joined_from_parts(spark, tmp):
    df = spark.range(0, 1000, 1, 7).selectExpr("id AS `a,\"b`", "concat('x', id) AS s", "CASE WHEN id % 2 = 0 THEN 'l\nm' END AS t")
    out = os.path.join(tmp, "one")
    write_csv(df, out, single_file=True)
    write_csv(df.coalesce(1), os.path.join(tmp, "plain"))
    plain = [f for f in os.listdir(os.path.join(tmp, "plain")) if f.endswith(".csv")][0]
    assert [f for f in os.listdir(out) if not f.startswith((".", "_"))] == ["part-00000.csv"]
    assert open(os.path.join(out, "part-00000.csv"), "rb").read() == open(os.path.join(tmp, "plain", plain), "rb").read()
    write_csv(df.limit(0), os.path.join(tmp, "none"), single_file=True)
    assert open(os.path.join(tmp, "none", "part-00000.csv")).read() == '"a,""b",s,t\n'


def test_reject_detail(spark, tmp):
    src = os.path.join(tmp, "src")
    _write(src, "a.csv", "k,amt,n\n1,x,1\n2,y y,2\n3,5,q\n4,,\n5,a" + "z" * 500 + ",1\n")
    _write(src, "b.csv", "k,amt,n\n1,1,1\n")
    df, res = _clean(spark, tmp, src)
    assert "__rejects" not in df.columns and res.rejects == {"k": 0, "c": 3, "n": 1}
    got = {(r["source_file"][-5:], r["column"]): (r["n"], r["first_row"], r["last_row"], r["samples"]) for r in res.reject_detail.collect()}
    assert got == {("a.csv", "c"): (3, 2, 6, ["x", "a" + "z" * 199]), ("a.csv", "n"): (1, 4, 4, ["q"])}
    again, res = _clean(spark, tmp, src, mode="append")
    assert again.columns == df.columns and res.reject_detail.agg(F.sum("n")).first()[0] == 4
    text = BigTableConfig("q", "t", [])
    ws = Workspace(spark, os.path.join(tmp, "ws-text"))
    assert C.clean(ws, CleanPipeline("c", src, "q"), [Rule("r", [RuleSource("*.csv", 1)], [RuleField("k", "k", 0)])], text).reject_detail.count() == 0
