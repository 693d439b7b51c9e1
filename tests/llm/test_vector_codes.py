import hashlib
import math

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import vector_codes as vc
from ledgerloom.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, entry int, row long, vec string, error long, moved boolean, l int"
FILL = (1, 2, "x", 3, True, 4)


def _table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, label, *FILL) for i, v, label in rows], schema)


def _brute(rows):
    """The contract with Python integers, a part at a time. Rows all have one length that 4 divides."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[k * len(v) // 4:(k + 1) * len(v) // 4] for k in range(4)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    books = [[list(cut(first[i])[p]) for i in sorted(first)[:256]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[nearest(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [nearest(part, book) for part, book in zip(cut(v), books)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label])
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == label), sha) for i, c, e, label in out), key=repr)


def _rows(n=500, dim=8):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, dim))
    rows = [(int(k), [float(np.float32(x)) for x in centres[k % 40] + 0.2 * rng.normal(size=dim)], int(k % 7) if k % 11 else None) for k in rng.permutation(n)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(n // 2)]  # copies: a third of all rows
    rows += [(5, rows[3][1], 2), (5, rows[3][1], 2), (None, rows[4][1], None)]  # repeated ids, none
    return rows + [(2000, None, 1), (2001, [None] * dim, 1), (2002, [math.nan] + [0.0] * (dim - 1), 1), (2003, [math.inf] + [0.0] * (dim - 1), 1), (2004, [0.0] * dim, 1)]


def test_rows(spark):
    got = vc.query(_table(prepare(spark), _rows()).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(_rows())


def test_owners_are_salted_and_few_members_move(spark):
    """A copy that a third of all rows hold has many owners, and later shuffles carry movers only."""
    rows = vc.integers(_table(prepare(spark), _rows()), "vec_id", "embedding", "label")
    books = vc.seeds(rows)
    first = vc.first_members(rows, books)
    size = vc.sizes(first)
    dealt = vc.dealt(first, size)
    per = [r.n for r in dealt.groupBy(vc.F.spark_partition_id().alias("p")).agg(vc.F.count(vc.F.lit(1)).alias("n")).collect()]
    assert sum(per) == 4 * rows.count() and max(per) < 2 * sum(per) / 8
    marked = vc.reassigned(dealt, vc.updated(dealt, books))
    assert 0 < marked.filter("moved").count() < sum(per) / 3


def test_exact_distances_beyond_doubles():
    rng = np.random.default_rng(1)
    parts, book = rng.integers(-vc.CLAMP, vc.CLAMP, (50, 4)), rng.integers(-vc.CLAMP, vc.CLAMP, (9, 4))
    at, error = vc.nearest(parts, book)
    for k, p in enumerate(parts.tolist()):
        assert (int(error[k]), int(at[k])) == min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(book.tolist()))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_few_ids_large_values_and_other_lengths(spark, kind):
    rows = [(3, [1.0, -0.5, 0.25, 1e30], 1), (1, [0.0, 0.0, 0.0, 0.0], None), (2, [1.0, -0.5, 0.25, -1e30], None), (9, [1.0], 1), (8, [], 2)]
    out = {r.vec_id: r for r in vc.query(_table(prepare(spark), rows, SCHEMA.replace("float", kind))).collect()}
    assert {i: (r.code, r.error) for i, r in out.items()} == {1: ("00000000", 0), 2: ("01010101", 0), 3: ("01010102", 0), 9: (None, None), 8: (None, None)}
    assert out[1].label_error == 0 and out[8].label_error is None


def test_empty_tables(spark):
    assert vc.query(_table(prepare(spark), [])).collect() == []
    assert vc.query(_table(spark, [(1, None, 1)])).collect() == []
    assert [tuple(r)[:3] for r in vc.query(_table(spark, [(None, [1.0] * 4, 1)])).collect()] == [(None, None, None)]


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", _rows(300))
    assert sorted(con.execute(vc.ORACLE).fetchall(), key=repr) == _brute(_rows(300))
