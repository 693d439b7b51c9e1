"""Properties of header names over random rows of headers."""
import random

from ledgerloom.operators.headers import canonicalize, resolve


def _sheets():
    rng = random.Random(11)
    words = ["ort", "ort_2", "ort_1", "maß", "", "_1", "zahl", "zahl_10"]
    return [[rng.choice(words) for _ in range(rng.randint(1, 12))] for _ in range(60)]


def _canon(spark, sheets):
    df = spark.createDataFrame([(k, i, h) for k, row in enumerate(sheets) for i, h in enumerate(row)], "sheet int, pos int, h string")
    return canonicalize(df, ["sheet"])


def test_names_are_unique_keep_order_and_leave_single_headers(spark):
    sheets = _sheets()
    got = {}
    for r in _canon(spark, sheets).collect():
        got.setdefault(r["sheet"], {})[r["pos"]] = r["name"]
    for k, row in enumerate(sheets):
        names = [got[k][i] for i in range(len(row))]
        assert len(set(names)) == len(names)
        for h in set(row):
            mine = [n for n, x in zip(names, row) if x == h]
            if row.count(h) == 1:
                assert mine == [h]
                continue
            numbers = [int(n.removeprefix(f"{h}_")) for n in mine]
            assert numbers == sorted(numbers)
            # the numbers left out are those that a header is spelled with
            assert all(f"{h}_{i}" in row for i in set(range(1, numbers[-1])) - set(numbers))


def test_resolve_finds_every_name_and_no_bare_repeat(spark):
    sheets = _sheets()
    canon = _canon(spark, sheets).cache()
    pairs = [(r["sheet"], w) for r in canon.collect() for w in (r["name"], r["name"] + "\r", r["h"], "nirgends")]
    wanted = spark.createDataFrame(sorted(set(pairs)), "sheet int, source_header string")
    at = {(r["sheet"], r["name"]): r["pos"] for r in canon.collect()}
    for r in resolve(canon, wanted, ["sheet"]).collect():
        w, row = r["source_header"], sheets[r["sheet"]]
        plain = w.replace("\r", "")
        if (r["sheet"], plain) in at:
            assert (r["status"], r["idx"]) == ("ok", at[r["sheet"], plain]), w
        else:
            assert r["status"] == ("duplicate" if row.count(w) > 1 else "absent" if w == plain else r["status"]) and r["idx"] is None, w


def test_numbers_skip_headers_spelled_like_them_without_a_list_of_candidates(spark):
    """Names as counted one by one; the plan makes no candidates, whose number is that of a sheet's repeated headers times its columns."""
    rng = random.Random(5)
    words = ["a", "a_1", "a_2", "a_02", "a_2_1", "a_4", "a_99999999999999999999", "_", "__1", "a\nb", "a\nb_1"]
    sheets = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    got = _canon(spark, sheets)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    names = {(r["sheet"], r["pos"]): r["name"] for r in got.collect()}
    for k, row in enumerate(sheets):
        last = {}
        for i, h in enumerate(row):
            if row.count(h) == 1:
                assert names[k, i] == h
                continue
            last[h] = next(n for n in range(last.get(h, 0) + 1, 100) if f"{h}_{n}" not in row)
            assert names[k, i] == f"{h}_{last[h]}"
    assert len(names) == sum(map(len, sheets))
