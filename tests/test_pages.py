"""Q7 pages, D18 recursion, D22 frames."""
import contextlib
import io
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.frames import groups_frame
from ledgerloom.operators.recursion import RecursionLimitError, recursive_union
from ledgerloom.plans import pages
from ledgerloom.plans.statements import run_sql
from ledgerloom.plans.workspace import MASTER, Workspace


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("large", [100_000, 5])
def test_pages_in_lineage_order(spark, tmp, monkeypatch, large):
    monkeypatch.setattr(pages, "LARGE_GROUP", large)
    monkeypatch.setattr(pages, "BLOCK_ROWS", 4)
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    rows = [(f"f{f}", "s", r, f * 100 + r) for f in range(4) for r in range(2, 25, 1 + f)] + [("f2", "t", 2, 7)]
    df = spark.createDataFrame(rows, "__source_file string, __source_sheet string, __source_row bigint, v int")
    ws.write_table(df.orderBy(F.rand(1)), MASTER, "t")
    want = sorted(rows)
    for offset, limit in ((0, 3), (0, 1000), (5, 7), (20, 30), (len(rows) - 2, 5), (len(rows), 5), (3, 0)):
        got, total = pages.page(ws, MASTER, "t", offset, limit)
        assert total == len(rows) and [tuple(r) for r in got.collect()] == want[offset:offset + limit], (offset, limit)
    plan = _plan(pages.page(ws, MASTER, "t", 5, 7)[0])
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "PushedFilters: [" in plan
    ws.append(df.limit(1), MASTER, "t")
    assert pages.page(ws, MASTER, "t", 0, 1)[1] == len(rows) + 1          # counted again for the new version


def test_pages_in_storage_order(spark, tmp):
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    ws.write_table(spark.range(50).repartition(3), MASTER, "t")
    whole = [r.id for r in pages.page(ws, MASTER, "t", 0, 50)[0].collect()]
    assert sorted(whole) == list(range(50))
    assert [r.id for o in range(0, 50, 8) for r in pages.page(ws, MASTER, "t", o, 8)[0].collect()] == whole
    ws.delete_where(MASTER, "t", "true")
    assert pages.page(ws, MASTER, "t")[1] == 0 and pages.page(ws, MASTER, "t")[0].collect() == []


def _reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_recursion_ends_on_cycles_and_has_no_level_limit(spark, tmp):
    edges = [(i, i + 1) for i in range(130)] + [(130, 0), (7, None), (500, 501)]
    ws = Workspace(spark, os.path.join(tmp, "ws"))
    ws.write_table(spark.createDataFrame(edges, "a int, b int"), MASTER, "edges")
    sql = ('WITH RECURSIVE few AS (SELECT a, b FROM edges WHERE a < 1000), reach(n) AS (SELECT b FROM few WHERE a = 3 UNION SELECT few.b FROM few JOIN reach ON few.a = reach.n) '
           'SELECT n FROM reach')
    got = [r.n for r in run_sql(ws, sql).collect()]
    assert len(got) == len(set(got)) and set(got) == _reach(edges, 3)


def test_recursion_that_keeps_rows(spark):
    seed = spark.createDataFrame([(1,)], "n int")
    assert sorted(r.n for r in recursive_union(seed, lambda d: d.filter("n < 20").select(F.col("n") * 1.0 + 1), distinct=False).collect()) == list(range(1, 21))
    with pytest.raises(RecursionLimitError):
        recursive_union(seed, lambda d: d, distinct=False, max_levels=3)
    assert recursive_union(seed.limit(0), lambda d: d).collect() == []
    with pytest.raises(ValueError):
        recursive_union(seed, lambda d: d.select("n", "n"))


def test_groups_frame(spark):
    rows = [(k % 3, (k * 7) % 5 if k % 11 else None, k) for k in range(60)]
    df = spark.createDataFrame(rows, "p int, o int, v int")
    got = {r.v: (r.s, r.n) for r in groups_frame(df, ["p"], [F.col("o").asc_nulls_last()], -1, 1, s=F.sum("v"), n=F.count("v")).collect()}
    for p, o, v in rows:
        keys = sorted({x[1] for x in rows if x[0] == p}, key=lambda x: (x is None, x))
        near = keys[max(0, keys.index(o) - 1):keys.index(o) + 2]
        inside = [x[2] for x in rows if x[0] == p and x[1] in near]
        assert got[v] == (sum(inside), len(inside))
    whole = groups_frame(df, ["p"], ["o"], Window.unboundedPreceding, Window.unboundedFollowing, n=F.count("v"))
    assert {r.n for r in whole.collect()} == {20}
