import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.globs import glob_to_regex
from ledgerloom.functions.transforms import normalize_date, to_cents, trim_text
import re


@pytest.mark.parametrize("pattern,path,hit", [
    ("**/*.csv", "a.csv", True), ("**/*.csv", "x/y/a.csv", True), ("*.csv", "x/a.csv", False),
    ("x/**", "x/y/z.xlsx", True), ("序时账*.XLS", "序时账2024.XLS", True), ("序时账*.XLS", "序时账2024.xls", False),
    ("a?.csv", "ab.csv", False), ("a?.csv", "a?.csv", True), ("[ab].csv", "a.csv", False), ("[ab].csv", "[ab].csv", True),
    ("**/b=0/*.csv", "p/b=0/f.csv", True), ("*/*.csv", "p\\q/f.csv", False),
])
def test_glob(pattern, path, hit):
    # the Java regex flavour used here is also valid Python for these patterns
    assert bool(re.match(glob_to_regex(pattern), path)) is hit


def _one(spark, expr, values, kind="s"):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"), F.lit(kind))).collect()]


def test_to_cents_text(spark):
    got = _one(spark, to_cents, ["123.45", "-0.05", "100", "", None, "   ", "¥1,234.50", "￥ 2 000", "abc",
                                 "0x10", "1e3", "-0.125", "1.005", ".5", "5."])
    assert got == [12345, -5, 10000, None, None, 0, 123450, 200000, None, None, 100000, -12, 100, 50, 500]


def test_to_cents_number_and_bool(spark):
    assert _one(spark, to_cents, ["123.45", "-5"], kind="n") == [12345, -500]
    assert _one(spark, to_cents, ["true"], kind="b") == [None]


def test_normalize_date(spark):
    got = _one(spark, normalize_date, ["2024-01-15", "2024/1/5", "2024.3.07", "2024-01", "45292", "45292.75",
                                       "  2024/1/5 ", "   ", "", None, "abc", "20000", "99999999", "2024/13/45"])
    assert got == ["2024-01-15", "2024-01-05", "2024-03-07", "2024-01", "2024-01-01", "2024-01-01",
                   "2024-01-05", "", None, None, "abc", "20000", "99999999", "2024-13-45"]


def test_trim(spark):
    got = _one(spark, trim_text, ["", "  a ", "　b ", None, "﻿c"])
    assert got == [None, "a", "b", None, "c"]
