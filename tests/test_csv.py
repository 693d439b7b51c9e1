"""CSV record scan: written cells are read back, odd texts follow a parity rule, and no
row depends on how Spark cuts the files."""

import csv
import io
import os
import random
import re
from contextlib import contextmanager

from ledgerloom.sources.csvrows import csv_raw_rows

TINY_SPLITS = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as fh:
        fh.write(text)


def by_file(rows):
    got = {}
    for r in rows:
        got.setdefault(r["source_file"].rsplit("/", 1)[-1], {})[r["row_no"]] = list(r["cells"])
    return {k: ([v[i] for i in sorted(v)], sorted(v) == list(range(1, len(v) + 1))) for k, v in got.items()}


def outside(pattern, text):
    """Pieces of ``text`` between the matches that have an even number of quotes before them."""
    cuts = [m for m in re.finditer(pattern, text) if text.count('"', 0, m.start()) % 2 == 0]
    ends = [0, *(m.end() for m in cuts)]
    return [text[a:b] for a, b in zip(ends, [*(m.start() for m in cuts), len(text)])]


def unquoted(cell):
    return re.sub(r'"((?:[^"]|"")*)"?', lambda m: m[1].replace('""', '"'), cell)


def by_parity(text):
    records = [[unquoted(c) for c in outside(",", r)] for r in outside(r"\r\n|\r|\n", text)]
    return records[:-1] if records[-1] == [""] else records


def test_written_cells_are_read_back(spark, tmp):
    rng = random.Random(11)
    pieces = ["a", "bc", "中", ",", '"', "\n", "\r\n", " ", "x,y", "\x00", "\x01", "\x01a", ""]
    tables = {}
    for i in range(8):
        rows = [["".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(3)] for _ in range(rng.randint(1, 25))]
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        tables[f"t{i}.csv"] = rows
        put(tmp, f"t{i}.csv", out.getvalue())
    with settings(spark, TINY_SPLITS):
        got = by_file(csv_raw_rows(spark, tmp).collect())
    assert got == {k: (v, True) for k, v in tables.items()}


def test_odd_texts_follow_parity(spark, tmp):
    rng = random.Random(7)
    pieces = ["a", "b", "中", ",", '"', '""', "\n", "\r\n", "\r", " ", "x,y", '"q,"', "\x00"]
    texts = {f"f{i}.csv": "".join(rng.choice(pieces) for _ in range(rng.randint(1, 300))) for i in range(12)}
    texts |= {"plain.csv": "h1,h2\n" + "".join(f"{i},{i * 2}\n" for i in range(300)), "crlf.csv": "a,b\r\n1,2\r\n\r\n3,4",
              "bom.csv": "﻿a,b\n1,2\n\n", "bom_open.csv": "﻿a,b\n1,2", "blank.csv": "a\n\n"}
    for name, t in texts.items():
        put(tmp, name, t)
    with settings(spark, TINY_SPLITS):
        got = by_file(csv_raw_rows(spark, tmp).collect())
    assert got == {k: (w, True) for k, t in texts.items() if (w := by_parity(t.removeprefix("﻿")))}


def test_rows_do_not_depend_on_splits(spark, tmp):
    """Splits change between the plan and the read: no row and no number may change."""
    for f in range(3):
        put(tmp, f"s{f}.csv", "id,v\n" + "".join(f"{i},{i % 7}\n" for i in range(4000)))
    put(tmp, "q.csv", "id,v\n" + "".join(f'{i},"x\n{i}"\n' for i in range(500)))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.leafNodeDefaultParallelism": "4"}):
        rows = csv_raw_rows(spark, tmp)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.leafNodeDefaultParallelism": "13", "spark.sql.files.openCostInBytes": "0"}):
        got = by_file(rows.collect())
    assert {k: (len(v[0]), v[1]) for k, v in got.items()} == {"s0.csv": (4001, True), "s1.csv": (4001, True), "s2.csv": (4001, True), "q.csv": (501, True)}
    assert got["q.csv"][0][500] == ["499", "x\n499"] and got["s1.csv"][0][4000] == ["3999", str(3999 % 7)]


def test_simple_text_is_neither_sorted_nor_shuffled(spark, tmp):
    put(tmp, "a.csv", "id,v\n" + "".join(f"{i},{i}\n" for i in range(50)))
    info = {}
    plan = csv_raw_rows(spark, tmp, info=info)._jdf.queryExecution().executedPlan().toString()
    assert info["complex_splits"] == 0
    text_side = [x for x in plan.splitlines() if re.match(r"[ +-]*:", x)]  # the join's left child
    assert any("FileScan" in x or "Scan parquet" in x for x in text_side)
    assert not any(re.search("Sort|Exchange|Window", x) for x in text_side)


def test_lock_files_and_case(spark, tmp):
    for name, t in {"A.CSV": "x\n1\n", "~$A.csv": "x\n", "b.txt": "x\n"}.items():
        put(tmp, name, t)
    names = {r["source_file"].rsplit("/", 1)[-1] for r in csv_raw_rows(spark, tmp).collect()}
    assert names == {"A.CSV"}


def test_large_files_are_dealt_apart(spark, tmp):
    """Each file is one task's, and no task has two files while another has none."""
    from pyspark.sql import functions as F

    from ledgerloom.suite.fixtures import by_file, write_csv_folder
    rows = spark.range(400).select((F.col("id") % 8).cast("string").alias("k"), F.when(F.col("id") % 8 == 3, None).otherwise(F.col("id") % 2).alias("b"), "id")
    dealt = by_file(rows, ["k", "b"], 8).select("k", "b", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(dealt) == 8 and len({r.p for r in dealt}) == 8
    out = write_csv_folder(rows, f"{tmp}/out", ["k", "b"], ["id"], 8)
    assert spark.read.option("header", "true").csv(out).count() == 400


def test_only_records_at_the_ends_of_splits_are_shuffled_after_their_lines(spark, tmp):
    """Records over many lines and splits read as written; after the lines are staged no plan of the result groups whole splits."""
    from ledgerloom.sources.csvrows import csv_raw_rows
    rng = random.Random(8)
    cells = [[f"{i}", "".join(rng.choice(["x", "\n", "\r", ",", '"', "long text "]) for _ in range(rng.randint(0, 60)))] for i in range(300)]
    with open(f"{tmp}/a.csv", "w", newline="") as fh:
        fh.write("".join(",".join('"' + c.replace('"', '""') + '"' for c in row) + "\n" for row in cells))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        info = {}
        got = {r["row_no"]: r["cells"] for r in csv_raw_rows(spark, f"{tmp}/a.csv", info=info).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert info["splits"] > 3 and [got[i + 1] for i in range(300)] == cells and len(got) == 300
    from ledgerloom.session import work_dir
    import os
    assert os.path.isdir(work_dir(spark, "csv-records")) and not os.path.isdir(work_dir(spark, "csv-segments"))


def test_headers_are_found_without_splitting_every_line(spark):
    """No test of the cells reaches the rows that hold no header."""
    from pyspark.sql import functions as F

    from ledgerloom.operators.headers import header_long
    rows = spark.range(5).select("id", F.split(F.col("id").cast("string"), ",").alias("cells"))
    plan = header_long(rows, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
