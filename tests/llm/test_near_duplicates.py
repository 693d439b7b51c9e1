import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import documents, odd_rows, prose

from ledgerloom.llm import chosen_path, components
from ledgerloom.llm.common import prepare


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """Smallest reachable id per row, by comparing all pairs."""
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((repr(i), len(shingles(t)), repr(least.get(root(k)) if i is not None else None)) for k, (i, t) in enumerate(rows))


def found(spark, rows):
    out = chosen_path.query(documents(prepare(spark), rows)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in out)


def test_odd_rows(spark):
    assert found(spark, odd_rows()) == brute(odd_rows())


@pytest.mark.parametrize("exhaustive", [16, 1000])
def test_group_larger_than_a_node(spark, monkeypatch, exhaustive):
    """Near copies in a group far over the node limit, and texts that resemble it too little."""
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    monkeypatch.setattr(chosen_path, "EXHAUSTIVE", exhaustive)
    rng = random.Random(1)
    base = prose(rng, 150).split()

    def edited(n):
        w = list(base)
        for _ in range(n):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        return " ".join(w)
    rows = [(k, edited(rng.choice([0, 1, 2, 3, 4, 9]))) for k in range(60)] + [(100 + k, prose(rng, 40)) for k in range(20)]
    assert found(spark, rows) == brute(rows)


def test_shared_paths_at_every_level():
    """Of 400 pairs at a similarity of 0.75, none may lose its last common node, down to the last level."""
    rng = np.random.default_rng(7)
    one = rng.integers(0, 2**32, (400, chosen_path.TOKENS), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < 0.75, one, rng.integers(0, 2**32, one.shape, dtype=np.uint32))
    paths = [x.tobytes() for x in np.concatenate([one, two])]
    rows = pd.concat(chosen_path._roots([pd.DataFrame({"class_id": np.arange(800), "path": paths})]))
    for level in range(chosen_path.MAX_LEVELS + 1):
        if level:
            rows = pd.concat(chosen_path._branch([rows.assign(m=1, path=[paths[i] for i in rows["id"]])]))
        rows = rows.drop_duplicates().assign(pair=rows["id"] % 400)
        rows = rows[rows.groupby(["node", "pair"])["id"].transform("size") == 2]
        assert rows["pair"].nunique() == 400, level


def test_merged_nodes_keep_their_picks(spark):
    rows = prepare(spark).createDataFrame([(n, i) for n in range(3) for i in (1, 2)] + [(9, i) for i in (1, 2, 3)] + [(10, 1)], "node long, id long")
    nodes = sorted(map(tuple, chosen_path._nodes(rows).collect()))
    assert {(n, m) for *_, n, m in nodes} == {(2, 3), (3, 1)} and len(nodes) == 5
    path = np.arange(chosen_path.TOKENS, dtype=np.uint32).tobytes()
    out = pd.concat(chosen_path._branch([pd.DataFrame({"node": [0, 9], "id": [1, 3], "m": [3, 1], "path": [path, path]})]))
    assert out.groupby("id")["node"].nunique().to_dict() == {1: 6, 3: 2}


def test_no_rows_and_one_of_each(spark):
    assert found(spark, []) == []
    rows = odd_rows()
    left = chosen_path.one_of_each(documents(prepare(spark), rows))
    assert left.columns == documents(spark, []).columns
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    # 5 = 6, 1 = 7 = 7, 8 = 9 go down to one row each; rows without words or id stay
    gone = [rows[6], rows[7], rows[8], rows[10]]
    want = list(rows)
    for g in gone:
        want.remove(g)
    assert kept == sorted(want, key=repr)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9)], [(1, k) for k in range(2, 40)]])
def test_components(spark, edges):
    prepare(spark)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {}
    for a, b in edges * 40:
        low = min(want.get(a, a), want.get(b, b))
        want[a] = want[b] = low
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def _borderline(n=80, words=220, changed=14):
    """Texts of one origin with single words replaced, so that pairs lie on both sides of the threshold."""
    rng = random.Random(12)
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.randint(1, changed) // 2):
            w[k] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_dense_blocks_are_confirmed_in_their_task(monkeypatch):
    from ledgerloom.llm.shingles import binned, shingles, similar
    sets = [shingles(t.encode()) for t in _borderline()]
    n = len(sets)
    g = pd.DataFrame({"key": 5, "id": np.arange(n) + 100, "comp": np.arange(n) + 100, "side": 0, "size": [len(s) for s in sets],
                      "sig": [binned(s, chosen_path.BINS).tobytes() for s in sets], "hashes": [s.tobytes() for s in sets]})
    out = pd.concat(chosen_path._pairs(iter([g.drop(columns="hashes")]), False))
    assert out.values.tolist() == [[5, 5, True]]                     # no pair becomes a row
    links = pd.concat(chosen_path._links_within(iter([g])))
    assert len(links) < n
    every = {(a, b) for b in range(n) for a in range(b) if similar(g["hashes"][a], g["hashes"][b], chosen_path.PERCENT)}
    for wide in (0, 10**9):
        monkeypatch.setattr(chosen_path, "MOST_WIDE", wide)
        assert {tuple(sorted(p)) for p in chosen_path._similar_pairs(g).tolist()} == every
    near = [{a, b} for a in range(n) for b in range(a) if similar(g["hashes"][a], g["hashes"][b], chosen_path.PERCENT)]
    assert len(near) > 3 * n and len(near) < n * (n - 1) / 2 - n

    def parts(edges):
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root
    assert parts([tuple(p) for p in near]) == parts([(u - 100, v - 100) for u, v in links.values.tolist()])


def test_borderline_group(spark):
    texts = _borderline()
    rows = [(k, t) for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = chosen_path.query(documents(prepare(spark), rows)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(chosen_path.ORACLE).fetchall())


def test_settled_records_are_not_copied_to_blocks(spark, monkeypatch):
    """Records of a node's largest component go to the blocks of the others only; a node without a likely pair is not compared again."""
    monkeypatch.setattr(chosen_path, "LIMIT", 8)
    monkeypatch.setattr(chosen_path, "TILE", 1)
    rng = random.Random(4)
    base = prose(rng, 150).split()

    def edited(n):
        w = list(base)
        for _ in range(n):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        return " ".join(w)
    compared, exhaust = [], chosen_path._Join.exhaust

    def spied(self, keyed):
        compared.extend(r.id for r in keyed.collect())
        exhaust(self, keyed)
    monkeypatch.setattr(chosen_path._Join, "exhaust", spied)
    rows = [(k, edited(1)) for k in range(60)] + [(100 + k, edited(12)) for k in range(4)]
    assert found(spark, rows) == brute(rows)
    assert 0 < len(compared) <= chosen_path.TREES * chosen_path.BRANCHES * (60 + 4 * 9)  # of 64 * 8 in each node
    compared.clear()
    rows = [(0, " ".join(base)), (1, edited(12))]
    assert found(spark, rows) == brute(rows)
    assert not compared
