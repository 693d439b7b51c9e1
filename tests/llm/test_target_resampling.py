import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from helpers import documents, odd_rows, prose

from ledgerloom.llm import target_resampling as tr
from ledgerloom.llm.common import prepare

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(tr.UPPER, tr.LOWER)


def _features(text):
    w = WORDS.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def _brute(rows, target):
    """The contract, a document at a time."""
    def count(texts):
        out = [0] * 10_000
        for t in texts:
            for b in _features(t)[1]:
                out[b] += 1
        return out
    s, t = count([r[1] for r in rows]), count(target)
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t)]
    out, drawable = [], []
    for k, (i, text, *_) in enumerate(rows):
        n, f = _features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= 20:
            drawable.append((-score, i is None, i or 0, len(f), k))
    for rank, x in enumerate(sorted(drawable)[:25 * len(drawable) // 100]):
        out[x[-1]][-1] = rank + 1
    return sorted(map(tuple, out), key=repr)


def _target(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def test_features_of_a_batch():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "é", "中", " ", ".", "\n", "7", "zz", "q" * 70, "x" * 48, "y" * 49]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "", "z" * 3000, ""]
    raw = [t.encode() for t in texts]
    doc, bucket, words = tr.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    for k, t in enumerate(texts):
        assert (int(words[k]), sorted(bucket[doc == k].tolist())) == (_features(t)[0], sorted(_features(t)[1]))


def _rows():
    rng = random.Random(4)
    rows = odd_rows() + [(100 + k, prose(rng, rng.randint(5, 60))) for k in range(400)]
    same = prose(rng, 40)
    return rows + [(1000 + k, same) for k in range(200)] + [(7000, same)] * 150  # copies, and a row repeated many times


@pytest.mark.parametrize("samples", [65_536, 20])
def test_rows(spark, monkeypatch, samples):
    monkeypatch.setattr(tr, "SAMPLES", samples)
    rows, target = _rows(), [prose(random.Random(9), 200), None, ""]
    got = tr.query(documents(prepare(spark), rows).repartition(5), _target(spark, target))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(rows, target)


def test_ranks_do_not_follow_the_partitions(spark):
    docs, target = documents(prepare(spark), _rows()), _target(spark, ["ka to mi"])
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n, parts in ((3, 1), (40, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        seen.append(sorted(map(tuple, tr.query(docs.repartition(parts), target).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]


def test_segments_split_rows_that_tie(spark):
    """Rows equal in score and id are ordered by their place, so no segment holds them all."""
    splitters = [(5, 1, 10), (5, 1, 20), (4, 9, 0)]
    got = tr._segment(splitters, np.array([6, 5, 5, 5, 5, 4, 3]), np.array([0, 1, 1, 1, 2, 9, 0]), np.array([0, 9, 10, 25, 0, 0, 5]))
    assert got.tolist() == [0, 0, 1, 2, 2, 3, 3]


def test_empty_tables_and_few_documents(spark):
    none = tr.query(documents(prepare(spark), []), _target(spark, []))
    assert none.collect() == []
    few = [(k, prose(random.Random(k), 30)) for k in range(3)]  # a quarter of 3 is none
    assert sorted(map(tuple, tr.query(documents(spark, few), _target(spark, [])).collect()), key=repr) == _brute(few, [])


def test_sql(spark):
    rows, target = _rows(), [prose(random.Random(9), 100), None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(target)))
    assert sorted(con.execute(tr.ORACLE).fetchall(), key=repr) == _brute(rows, target)
