import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import documents, odd_rows, prose
from test_lines import brute as line_brute
from test_models import _labelled
from test_near_duplicates import brute as near_brute
from test_rules import measures

from ledgerloom.llm import length_buckets, quality_gam
from ledgerloom.llm.common import prepare, staged


@pytest.fixture()
def tables(spark, tmp_path):
    def write(rows, labels):
        prepare(spark)
        documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)
    return write


def test_stages(spark, tables):
    rng = random.Random(12)
    rows, labels = _labelled(rng, 200)
    clean = {k for k, v, _ in labels if v and len(dict(rows)[k].split()) >= 50}
    copy, near = prose(rng, 120), prose(rng, 120).split()
    rows += odd_rows()[1:5] + [(1000 + k, copy + ".") for k in range(5)]
    rows += [(2000 + k, " ".join([*near[:60], f"other{k}", *near[61:]]) + ".") for k in range(3)]
    d = tables(rows, labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], d))
        assert kept[-1].columns == columns
    ids = [sorted(str(r.doc_id) for r in k.select("doc_id").collect()) for k in kept]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert sum(i in last for i in range(1000, 1005)) == 1 and 1000 in last
    assert sum(i in last for i in range(2000, 2003)) == 1
    assert len(clean & set(last)) >= 0.95 * len(clean)


def test_no_rows(spark, tables):
    assert corpus_pipeline.run(spark, tables([], [])).collect() == []


def _slow_score(model, x):
    """A document's score from the model's tables, one bin at a time."""
    def bin_of(edges, v):
        return sum(1 for e in edges if v >= e)
    total = model.intercept
    for j, table in enumerate(model.tables):
        total += table[bin_of(model.edges[j], x[j])]
    for (i, j), table in model.pairs:
        total += table[bin_of(model.pair_edges[i], x[i])][bin_of(model.pair_edges[j], x[j])]
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def _good_hosts(rows):
    """Sources whose failure rate, shrunk by a beta prior from the moments of all hosts' rates, is at most 0.8."""
    hosts = {}
    for _, text, source in rows:
        hosts.setdefault(source, []).append(measures(text)[-1])
    raw = [sum(x) / len(x) for x in hosts.values()]
    mean = sum(raw) / len(raw)
    var = sum((r - mean) ** 2 for r in raw) / len(raw)
    strength = mean * (1 - mean) / var - 1 if var else 0
    strength = strength if strength > 0 else 1
    return {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) <= 0.8}


def test_every_stage_against_brute_force(spark, tables):
    """Whole rows after each stage, each on what the stage before kept."""
    rng = random.Random(21)
    rows, labels = _labelled(rng, 160)
    rows = [(i, t, f"host{i % 5}") for i, t in rows]
    shared, near = prose(rng, 30), prose(rng, 150).split()
    rows += [(500 + k, prose(rng, 80) + ".\n" + shared + "\n" + prose(rng, 30) + ".", "pages") for k in range(12)]
    rows += [(600 + k, " ".join([*near[:70], f"other{k}", *near[71:]]) + ".", "copies") for k in range(6)]
    rows += [(700 + k, rows[3][1], "copies") for k in range(4)]
    rows += [(800 + k, "buy now " * 40, "spam") for k in range(20)] + [(900, prose(rng, 90) + ".", "spam")]
    d = tables(rows, labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def kept(df):
        return sorted((r.doc_id, r.text, r.source, r.n_chars, r.id, r.kept) for r in df.collect())

    def full(rows):
        return sorted((i, t, s, len(t), 9, True) for i, t, s in rows)

    model = quality_gam.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = [r for r in rows if _slow_score(model, quality_gam.features(r[1].encode())) >= 0.7]
    got = staged(stages["quality classifier"](spark, docs, d), "test")
    assert kept(got) == full(want) and 50 < len(want) < len(rows)

    hosts = _good_hosts(want)
    want = [r for r in want if not measures(r[1])[-1] and r[2] in hosts]
    got = staged(stages["quality rules"](spark, got, d), "test")
    assert kept(got) == full(want)

    source = {i: s for i, _, s in want}
    lines = line_brute(sorted((i, t) for i, t, _ in want))
    want = [(i, t, source[i]) for i, t in lines if t.split()]
    got = staged(stages["line dedup"](spark, got, d), "test")
    assert kept(got) == full(want) and any("\n" in t for _, t, _ in want)

    group = {int(i): int(c) for i, _, c in near_brute([(i, t) for i, t, _ in want])}
    want = [r for r in want if group[r[0]] == r[0]]
    got = staged(stages["near-dedup"](spark, got, d), "test")
    assert kept(got) == full(want)

    packed = stages["packing"](spark, got, d).collect()
    sizes = {i: len(t.split()) for i, t, _ in want}
    count = Counter(sizes.values())
    at = sorted(count)
    bounds = length_buckets.boundaries(np.array(at), np.array([count[x] for x in at]), length_buckets.N_BUCKETS)
    batches = {}
    for r in packed:
        assert r.tokens == sizes[r.doc_id] and r.length == min(b for b in bounds if b >= r.tokens) and bounds[r.bucket] == r.length
        batches.setdefault((r.bucket, r.length, r.batch), []).append(r.slot)
    assert sorted(r.doc_id for r in packed) == sorted(sizes)
    for (bucket, length, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) * length <= length_buckets.BUDGET or len(slots) == 1)
        room = max(length_buckets.BUDGET // length, 1)
        assert len(slots) == room or batch == max(b for k, _, b in batches if k == bucket)
