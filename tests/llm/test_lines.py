import os
import random

from helpers import documents, odd_rows, prose
from pyspark.sql import functions as F

from ledgerloom.llm import line_setjoin
from ledgerloom.llm.common import prepare, shared_path


def tokens(line):
    w = line.lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """Texts in the order of their id, each line against all earlier ones."""
    seen, out = [], []
    for i, t in rows:
        keep = []
        for line in t.split("\n"):
            s = tokens(line)
            if s and any(100 * len(s & x) >= 75 * len(s | x) for x in seen):
                continue
            if s:
                seen.append(s)
            keep.append(line)
        out.append((i, "\n".join(keep)))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(3)
    pool = [prose(rng, n) for n in (1, 3, 5, 8, 20, 60)]

    def line():
        w = rng.choice(pool).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(9999))
        return " ".join(w)
    rows = [(k, "\n".join(rng.choice([line(), prose(rng, 9), "", "  "]) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    got = line_setjoin.dedup(documents(prepare(spark), rows)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == brute(rows)
    assert got[0].__fields__[: len(documents(spark, []).columns)] == documents(spark, []).columns


def test_many_near_copies_of_a_line(spark):
    rng = random.Random(4)
    base = prose(rng, 50).split()
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((k, " ".join(w)))
    got = line_setjoin.dedup(documents(prepare(spark), rows)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, t) for i, t in _any_earlier(rows)]


def _any_earlier(rows):
    sets = [tokens(t) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        yield i, "" if any(100 * len(sets[k] & s) >= 75 * len(sets[k] | s) for s in sets[:k]) else t


def test_odd_rows(spark):
    got = sorted(((r.doc_id, r.text, r.dedup_removed) for r in line_setjoin.dedup(documents(prepare(spark), odd_rows())).collect()), key=repr)
    text = dict(odd_rows())
    want = [(1, text[1], 0), (2, None, 0), (3, "", 0), (4, text[4], 0), (None, text[None], 0), (5, text[5], 0), (6, "", 1), (7, "", 1), (7, "", 1),
            (8, "a b", 0), (9, "", 1), (10, text[10], 0), (11, text[11], 0)]
    assert got == sorted(want, key=repr)
    assert line_setjoin.query(documents(spark, [])).collect() == []


def test_lines_that_agree_in_32_bits(spark):
    """Different short lines and different shingles whose Murmur3 hashes are equal are different lines."""
    words = prepare(spark).range(400_000).select(F.concat(F.lit("w"), "id").alias("w"))
    rows = []
    for first, hashed in (("", F.hash(F.array("w"))), ("a b c d ", F.hash(F.struct(*(F.lit(x) for x in "abcd"), "w")))):
        pairs = words.groupBy(hashed.alias("h")).agg(F.collect_list("w").alias("w")).filter(F.size("w") > 1).collect()
        assert pairs
        rows += [(len(rows) + k, first + w) for k, w in enumerate(w for p in pairs for w in p.w)]
    got = line_setjoin.dedup(documents(spark, rows)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == rows


def test_tokens_do_not_stay_on_disk(spark):
    """What is left below the shared folder is small beside the texts: no 64-bit token of every line, which alone is larger than they are."""
    rng = random.Random(6)
    rows = [(k, "\n".join(prose(rng, 60) for _ in range(20))) for k in range(60)]
    rows += [(100, rows[0][1] + " more")]
    folder = shared_path(prepare(spark), "x").rpartition("/")[0].removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    gone = line_setjoin.removed_lines(documents(spark, rows).select("doc_id", "text")).collect()
    assert [(r.doc, sorted(r.gone)) for r in gone] == [(100, list(range(20)))]
    files = [os.path.join(d, f) for x in set(os.listdir(folder)) - before for d, _, fs in os.walk(os.path.join(folder, x)) for f in fs if f.endswith(".parquet")]
    assert 2 * sum(map(os.path.getsize, files)) < sum(len(t) for _, t in rows)


def test_sets_are_shuffled_for_their_pairs_only(spark, monkeypatch):
    """Fetched sets are not dealt by their class unless rows repeat id and text; later pairs read no sets of earlier ones."""
    made, kept = [], line_setjoin.staged

    def spied(df, name):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)
    monkeypatch.setattr(line_setjoin, "staged", spied)
    rng = random.Random(9)
    base = prose(rng, 50).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((k, " ".join(w)))
    got = line_setjoin.dedup(documents(prepare(spark), rows)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == list(_any_earlier(rows))
    sets = [p for n, p in made if n == "sets"]
    assert sets and not any("hashpartitioning(rank" in p and "first(toks" in p for p in sets)
    made.clear()
    twice = [*rows, rows[0], rows[7]]
    got = line_setjoin.dedup(documents(spark, twice)).orderBy("doc_id").collect()
    assert [r.text for r in got if r.doc_id not in (0, 7)] == [t for i, t in _any_earlier(rows) if i not in (0, 7)]
    assert sum(n == "sets" for n, _ in made) > 1
    verify = line_setjoin._Verifier(None, "doc_id", "text", None)
    verify.sets = spark.createDataFrame([(k, [k]) for k in range(9)], "rank long, toks array<long>")
    monkeypatch.setattr(verify, "_fetch", lambda ranks: None)
    assert sorted(r.rank for r in verify._needed(spark.createDataFrame([(5, 3), (5, 2)], "x long, y long")).collect()) == [2, 3, 5]
