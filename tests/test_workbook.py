"""Workbook scan on hand-built books (F8-F13 layouts)."""

import os
import random

import pytest

from ledgerloom.sources.workbook import decode_escapes, number_text, read_workbooks
from ledgerloom.suite.xlsx_fixture import _Book


def _book(tmp, name, sheets):
    b = _Book()
    for sname, dim, rows in sheets:
        b.sheet(sname, dim, [(r, [c.replace("{S}", "") if "{S}" not in c else c for c in cells]) for r, cells in rows])
    p = os.path.join(tmp, name)
    with open(p, "wb") as fh:
        fh.write(b.bytes())
    return p, b


def test_escapes_round_trip():
    """Any text whose code units are written as escapes, some or all, reads as itself; other texts stay."""
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["Menge", " ", "\t", "\x01", "ß", "_", "x", "00", "é"]) for _ in range(rng.randint(0, 9)))
        every = "".join(f"_x{ord(c):04{rng.choice('xX')}}_" for c in text)
        assert decode_escapes(every) == text
        assert decode_escapes(text) == text
    assert decode_escapes("_x005f_x0009_|_x00g1_|_x9_") == "_x0009_|_x00g1_|_x9_"


@pytest.mark.parametrize("value", [0, -7, 12.25, -0.125, 1e15, 123456789.5, 3e-7, 2.5e-9, 1e21, -6.02e23])
def test_number_text_reads_back(value):
    text = number_text(repr(value))
    assert float(text) == value and (("e" in text) == (value != 0 and not 1e-7 <= abs(value) < 1e21)) and not text.endswith(".0")


def test_bounds_gaps_and_types(spark, tmp):
    b = _Book()
    rows = [(1, [f'<c r="A1" t="s"><v>{b.s("科目")}</v></c>', f'<c r="B1" t="s"><v>{b.s("金额")}</v></c>',
                 '<c r="C1" t="e"><v>#DIV/0!</v></c>']),
            (2, ['<c r="A2" t="inlineStr"><is><t>a</t></is></c>', '<c r="B2"><v>1.5</v></c>',
                 '<c r="C2" t="b"><v>1</v></c>']),
            (4, ['<c r="A4" t="inlineStr"><is><t>b</t></is></c>', '<c r="B4" t="e"><v>#NULL!</v></c>',
                 '<c r="C4" t="e"><v>#N/A</v></c>', '<c r="Q4"><v>0</v></c>']),
            (6, ['<c r="A6" t="inlineStr"><is><t></t></is></c>'])]
    b.sheet("S", "A1:XFD1000000", rows)
    p = os.path.join(tmp, "b.xlsx")
    with open(p, "wb") as fh:
        fh.write(b.bytes())
    got = {r["row_no"]: (list(r["cells"]), r["kinds"]) for r in read_workbooks(spark, [p]).collect()}
    # last row with a value is 4; column Q has a single value -> cut; row 3 is a gap
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1] == (["科目", "金额"], "ss")     # trailing error cell reads as '' and is trimmed
    assert got[2] == (["a", "1.5", "true"], "snb")
    assert got[3] == ([], "")
    assert got[4] == (["b"], "s")          # NULL error + trailing empties trimmed


def test_rows_of_a_book_are_written_as_they_come(tmp):
    """A sheet's rows go to the file while later ones are still to come; its dimension holds all of them."""
    import types
    import zipfile

    from ledgerloom.suite.xlsx_fixture import _orders_book
    rng, sizes, n = random.Random(3), [], 8000
    with open(os.path.join(tmp, "o.xlsx"), "w+b", buffering=0) as fh:
        def orders():
            for key in range(n):
                yield types.SimpleNamespace(key=key, price=rng.random(), serial=key, prio="1-URGENT", status="O", cust=rng.randrange(10**9))
                sizes.append(fh.tell())
        _orders_book(fh, orders(), n)
        assert 0 < sizes[n // 4] < sizes[n // 2] < sizes[-1]
        with zipfile.ZipFile(fh) as z:
            assert z.read("xl/worksheets/sheet2.xml").count(b"<row ") == n + 5
    with open(os.path.join(tmp, "long.xlsx"), "w+b") as fh:
        _orders_book(fh, iter(()), 2_000_000)
        with zipfile.ZipFile(fh) as z:
            assert f'ref="A1:XFD{4 + 1_999_999 + 1_999_999 // 50 + 3}"' in z.read("xl/worksheets/sheet2.xml").decode()


def test_small_books_share_tasks_and_keep_their_rows(spark, tmp):
    from ledgerloom.sources.workbook import _scan, read_workbooks
    paths = [_book(tmp, f"s{i}.xlsx", [("S", "A1:A1", [(1, [f'<c r="A1"><v>{i}</v></c>'])])])[0] for i in range(60)]
    assert _scan(spark, paths).rdd.getNumPartitions() < 30
    assert sorted(int(r["cells"][0]) for r in read_workbooks(spark, paths).collect()) == list(range(60))


def _books_of_all_sizes(tmp, rng):
    """Workbooks below a folder, with bytes of all kinds in them, and a file that is none; (folder, {path: rows})."""
    root, made = os.path.join(tmp, "all sizes"), {}
    os.makedirs(root)
    for k, n in enumerate([1, 40, 400]):
        values = [rng.choice([rng.random(), "<", "a<b\n", "é" * rng.randint(1, 300), rng.randrange(10**12)]) for _ in range(n)]
        cells = [f'<c r="A{r}" t="inlineStr"><is><t xml:space="preserve">{v.replace("<", "&lt;")}</t></is></c>' if isinstance(v, str) else f'<c r="A{r}"><v>{v!r}</v></c>'
                 for r, v in enumerate(values, 1)]
        path, _ = _book(root, f"b {k}+é.xlsx", [("one", "A1:A1", [(1, ['<c r="A1"><v>7</v></c>'])]), ("two", f"A1:B{n}", [(r, [c]) for r, c in enumerate(cells, 1)])])
        made[f"file:{path}"] = [v if isinstance(v, str) else number_text(repr(v)) for v in values]
    with open(os.path.join(root, "none.xlsx"), "wb") as fh:
        fh.write(b"no <zip<")
    return root, made


def _with_splits(spark, monkeypatch, limit, splits="1000"):
    """From now on files of more than ``limit`` bytes do not fit in a row, and splits are small."""
    from ledgerloom.sources import workbook
    monkeypatch.setattr(workbook, "MAX_WORKBOOK_BYTES", limit)
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, splits)


def _whole_splits(spark):
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


@pytest.mark.parametrize("limit", [0, 2500])
def test_sheets_of_books_larger_than_a_row_are_listed(spark, tmp, monkeypatch, limit):
    from ledgerloom.plans import inspect
    from ledgerloom.sources.workbook import workbook_sheets
    root, made = _books_of_all_sizes(tmp, random.Random(11))
    sizes = [os.path.getsize(p.removeprefix("file:")) for p in made]
    assert min(sizes) < 2500 < max(sizes)
    try:
        _with_splits(spark, monkeypatch, limit)
        listed, errors = workbook_sheets(spark, root)
        assert sorted(map(tuple, listed.collect())) == sorted((p, s, k) for p in made for k, s in enumerate(["one", "two"]))
        assert [(r["path"], r["error"].split(":")[0]) for r in errors.collect()] == [(f"file:{root}/none.xlsx", "BadZipFile")]
        assert inspect.sheets(spark, root).count() == 2 * len(made)
    finally:
        _whole_splits(spark)


@pytest.mark.parametrize("limit", [0, 2500])
def test_bounds_and_rows_of_books_larger_than_a_row(spark, tmp, monkeypatch, limit):
    from ledgerloom.sources.workbook import emit_workbooks, sheet_bounds
    root, made = _books_of_all_sizes(tmp, random.Random(12))
    try:
        _with_splits(spark, monkeypatch, limit)
        bounds = sheet_bounds(emit_workbooks(spark, root).filter("rec = 'sheet'"))
        assert sorted((r["source_file"], r["source_sheet"], r["row_end"]) for r in bounds.collect()) == sorted(
            (p, s, n) for p, v in made.items() for s, n in (("one", 1), ("two", len(v))))
        rows = read_workbooks(spark, [p.removeprefix("file:") for p in made]).filter("source_sheet = 'two'").orderBy("row_no").collect()
        assert {p: [r["cells"][0] for r in rows if r["source_file"] == p] for p in made} == made
    finally:
        _whole_splits(spark)


def test_a_book_of_which_a_piece_is_missing_is_reported():
    import pandas as pd

    from ledgerloom.sources.workbook import _emitter, _piece_emitter, _pieces
    b = _Book()
    b.sheet("S", "A1:A1", [(1, ['<c r="A1"><v>7</v></c>'])])
    data = b.bytes()
    lines = data.split(b"<")
    for last in ([], [b"more"]):  # what the text reader gives ends with or without a separator
        whole = data + b"<" if last else data
        batch = pd.DataFrame({"path": "p", "size": len(whole), "start": 0, "value": lines})
        pieces = pd.concat(_pieces(iter([batch[:5], batch[5:]]))).assign(wants=None)
        got = [r for f in _piece_emitter(iter([pieces])) for r in f["rec"]]
        assert got == [r for f in _emitter(iter([pd.DataFrame({"path": ["p"], "content": [whole], "wants": [None]})])) for r in f["rec"]]
    few = pd.concat(_pieces(iter([batch[:-3]]))).assign(wants=None)
    assert [tuple(r) for f in _piece_emitter(iter([few, pieces.assign(path="q")])) for r in f[["rec", "source_file"]].to_numpy()][0] == ("error", "p")


@pytest.mark.parametrize("limit", [0, 2500])
def test_header_rows_of_books_larger_than_a_row(spark, tmp, monkeypatch, limit):
    from ledgerloom.operators.detect import detect_header_row
    from ledgerloom.sources.workbook import emit_workbooks, shape_rows
    root, want = os.path.join(tmp, "headers"), {}
    os.makedirs(root)
    text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    for k, n in enumerate([3, 300]):
        at = 2 + k
        rows = [(1, [text("A1", "title")]), (at, [text(f"{c}{at}", f"column {c}") for c in "ABCD"]),
                *((at + r, [f'<c r="{c}{at + r}"><v>{r}.5</v></c>' for c in "ABCD"]) for r in range(1, n))]
        path, _ = _book(root, f"{k}.xlsx", [("S", f"A1:D{at + n}", rows)])
        want[f"file:{path}"] = at
    try:
        _with_splits(spark, monkeypatch, limit)
        raw, _, errors = shape_rows(emit_workbooks(spark, root))
        assert {r["source_file"]: r["header_row"] for r in detect_header_row(raw).collect()} == want and errors.count() == 0
    finally:
        _whole_splits(spark)
