import os

from ledgerloom.config import BigTableConfig, BigTableField, CleanPipeline, Rule, RuleField, RuleSource
from ledgerloom.plans.workspace import Workspace, bt_namespace
from ledgerloom.streaming.incremental import incremental_clean


def _write(d, name, text):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
        fh.write(text)


def test_new_files_are_appended_once(spark, tmp):
    src = os.path.join(tmp, "src")
    _write(src, "a.csv", "k,amt\n1,1.50\n2,2\n")
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    rule = Rule("r", [RuleSource("**/*.csv", 1)], [RuleField("k", "k", 0), RuleField("amt", "c", 1, True, ["coerce_cents"])])
    cfg = BigTableConfig("inc", "t", [BigTableField("k", "INTEGER"), BigTableField("c", "INTEGER")])
    p = CleanPipeline("inc", src, "inc")
    runs = incremental_clean(ws, p, [rule], cfg)
    assert [r.rows for r in runs] == [2]
    _write(src, "b.csv", "k,amt\n3,3.25\n")
    runs = incremental_clean(ws, p, [rule], cfg)
    assert [r.rows for r in runs] == [1]          # only the new file
    assert incremental_clean(ws, p, [rule], cfg) == []
    got = sorted((r["k"], r["c"]) for r in ws.read(bt_namespace("inc"), "t").collect())
    assert got == [(1, 150), (2, 200), (3, 325)]
