import hashlib
import math
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import documents, odd_rows, prose

from ledgerloom.llm import attention_lm, bpe_sql, cover_tree, quality_gam
from ledgerloom.llm.common import prepare

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return bpe_sql.Coder(PATH, PATTERN)


@pytest.fixture(scope="module")
def tik(coder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_bpe_is_tiktokens(coder, tik):
    rng = random.Random(3)
    texts = ["", " ", "  ", "a  b", " a", "a ", "\n\n x\n y", "a\xa0b　c", "x \n y", "don't 's 't", "aaaa" * 100, "=" * 500 + " " * 300, "é" * 300, "\x1c \x1d a",
             "a\r\n b  \r\n", "😀 😀😀", "".join(rng.choice("abcdethnio") for _ in range(1500)), "".join(rng.choice("ab") for _ in range(900))]
    texts += ["".join(rng.choice([" ", "a", "'", "s", "\n", "1", ".", "é", "\x85", "t"]) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    got = coder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tik.encode_ordinary(t) for t in texts]
    assert coder.decode(got) == [t.encode() for t in texts]


def test_bpe_of_long_words_in_bounded_memory(tik):
    """10,000 distinct words of 180 letters and one of 100,000, in a process of its own that may take 1.2 GB."""
    code = ("import random, sys, resource, time\n"
            "from ledgerloom.llm import bpe_sql\nimport public_tokenizers as p\n"
            "rng = random.Random(1)\nword = lambda n: ''.join(rng.choice('abcdethnio') for _ in range(n))\n"
            "c = bpe_sql.Coder(p.path('byte_bpe_50k.tiktoken'), p.PATTERN)\n"
            "texts = [' '.join(word(180) for _ in range(10_000)), word(100_000), word(900) + ' ' + word(1100)]\n"
            "got = c.encode(texts)\n"
            "assert c.decode(got) == [t.encode() for t in texts]\n"
            "import tiktoken\nt = tiktoken.Encoding('own', pat_str=p.PATTERN, mergeable_ranks=c.ranks, special_tokens={})\n"
            "import numpy as np\nassert all(np.frombuffer(g, '<u4').tolist() == t.encode_ordinary(x) for g, x in zip(got, texts))\n"
            "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n")
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True, timeout=600)
    assert int(out.stdout.split()[-1]) < 1200


def test_bpe_rows(spark, tik):
    rows = odd_rows()
    out = bpe_sql.query(documents(prepare(spark), rows)).collect()

    def want(i, t):
        ids = tik.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(map(tuple, out), key=repr) == sorted((want(*r) for r in rows), key=repr)
    full = bpe_sql.tokenize(documents(spark, rows[:1]), PATH, PATTERN).collect()
    assert (full[0].ids, bytes(full[0].decoded)) == (tik.encode_ordinary(rows[0][1]), rows[0][1].encode())
    assert bpe_sql.query(documents(spark, [])).collect() == []


def _unit(rng, n, dim, groups, spread):
    x = rng.normal(size=(n, dim))
    x[: n // 2] = rng.normal(size=(groups, dim))[rng.integers(0, groups, n // 2)] + spread * rng.normal(size=(n // 2, dim))
    return cover_tree._unit(x)


def _links(ids, x):
    """Links and smallest reachable id of each vector, by brute force."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T) >= 0.9
    label = np.array(ids)
    for _ in range(len(ids)):
        new = np.array([label[h].min() for h in hit])
        if (new == label).all():
            break
        label = new
    return {i: (int(h.sum()) - 1, int(c)) for i, h, c in zip(ids, hit, label, strict=True)}


@pytest.mark.parametrize("n, groups, dim, spread", [(300, 5, 64, 0.15), (400, 3, 8, 0.3), (200, 2, 3, 1.0), (1, 1, 5, 0.1), (2, 1, 5, 0.01)])
def test_dual_traversal(n, groups, dim, spread):
    rng = np.random.default_rng(1)

    def block(x):
        tree = cover_tree.cover_tree(x)
        order = tree.pop("order")
        for c, p, r, a in zip(tree["counts"], tree["parents"], tree["radii"], tree["ancestors"], strict=True):
            assert len(p) == len(r) == c and a.max() < c
        return {"x": x[order], "near": x[order].astype(np.float32), "copies": rng.integers(1, 4, len(x)), "tree": tree}
    x = _unit(rng, n, dim, groups, spread)
    a, b = block(x), block(cover_tree._unit(np.concatenate([x[: n // 3] * 3 + 0.05 * rng.normal(size=(n // 3, dim)), rng.normal(size=(5, dim))])))
    for p, q in ((a, a), (a, b), (b, b)):
        la, lb, u, v = cover_tree.traverse(p, q)
        hit = (p["x"] @ q["x"].T) >= 0.9
        if p is q:
            np.fill_diagonal(hit, True)
        assert (la == hit @ q["copies"]).all() and (lb == p["copies"] @ hit).all()
        shift = 0 if p is q else len(p["x"])
        i, j = np.nonzero(hit)
        size = shift + len(q["x"])
        assert (cover_tree._merge(size, u, v) == cover_tree._merge(size, i, j + shift)).all()


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    rng = np.random.default_rng(4)
    x = _unit(rng, 150, 16, 4, 0.12).astype(np.float32)
    ids = [int(i) for i in rng.permutation(1000)[:150]]
    want = _links([*ids, 2000, 2001], np.concatenate([x, x[:1], 7 * x[1:2]]).astype(float))
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(2000, x[0].tolist()), (2001, (7 * x[1]).tolist())]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3005, [float("inf")] * 16), (3006, [1.0, 2.0]),
           (None, x[0].tolist())]
    want |= {3006: (0, 3006)} | {i: (0, i) for i, _ in odd}
    table = prepare(spark).createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, label int, block int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.query(table).collect()}
    assert got == want
    assert cover_tree.query(table.limit(0)).collect() == []


@pytest.mark.parametrize("group_bytes, max_sent, times", [(32 << 20, 10**6, 1), (4 * 16 * 20 * 2, 0, 4)])
def test_blocks_are_sent_once_for_each_group(spark, monkeypatch, group_bytes, max_sent, times):
    """No tree goes to more tasks than there are groups (the root of the number of blocks, times more if a group must be small)."""
    monkeypatch.setattr(cover_tree, "BLOCK", 20)
    monkeypatch.setattr(cover_tree, "GROUP_BYTES", group_bytes, raising=False)
    monkeypatch.setattr(cover_tree, "MAX_SENT", max_sent, raising=False)
    trees, sent, real, staged = [], spark.sparkContext.accumulator(0), cover_tree._traverse, cover_tree.staged

    def counted(batches):
        def each():
            for b in batches:
                sent.add(sum(isinstance(v, bytes | bytearray) for c in b.columns for v in b[c]))
                yield b
        yield from real(each())

    def kept(df, name):
        out = staged(df, name)
        trees.extend([out] if name == "trees" else [])
        return out
    monkeypatch.setattr(cover_tree, "_traverse", counted)
    monkeypatch.setattr(cover_tree, "staged", kept)
    rng = np.random.default_rng(9)
    x = _unit(rng, 700, 16, 30, 0.12).astype(np.float32)
    table = prepare(spark).createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.query(table).collect()} == _links(list(range(700)), x.astype(float))
    blocks = trees[0].count()
    assert blocks > 35 and sent.value <= min(blocks, times * 8) * blocks


def test_gradients():
    rng = np.random.default_rng(0)
    enc = attention_lm.subwords(PATH, PATTERN)
    seqs = [attention_lm.sequence(enc, attention_lm.words(prose(random.Random(k), 30).encode())) for k in range(2)]
    coding = attention_lm.Coding(np.bincount(np.concatenate(seqs), minlength=enc.size + 1).astype(float))
    w = {k: x.astype(float) + rng.normal(size=x.shape) * 0.1 for k, x in attention_lm.start_weights(coding.prior).items()}
    sizes = np.array([len(s) - 1 for s in seqs])
    at, pad, owner = attention_lm.windows(np.cumsum(sizes) - sizes, sizes)
    scored = at[:, attention_lm.WINDOW - attention_lm.STRIDE:][~pad[:, attention_lm.WINDOW - attention_lm.STRIDE:]]
    assert sorted(scored) == list(range(sizes.sum()))  # each token once
    a = np.where(pad, 0, at)
    x, y = coding.inp[np.concatenate([s[:-1] for s in seqs])[a]], coding.cls[np.concatenate([s[1:] for s in seqs])[a[:, attention_lm.WINDOW - attention_lm.STRIDE:]]]
    real = ~pad[:, attention_lm.WINDOW - attention_lm.STRIDE:]

    def loss():
        z = attention_lm._forward(w, x, pad)[-1]
        return -(z[np.arange(len(z)), y.ravel()] * real.ravel()).sum() / real.sum()
    g = attention_lm._gradients(w, x, pad, y, real)
    for k in w:
        i = tuple(rng.integers(0, d) for d in w[k].shape) if k != "e" else (x[0, -1], 3)
        w[k][i] += 1e-5
        up = loss()
        w[k][i] -= 2e-5
        down = loss()
        w[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-5
    assert abs(np.exp(coding.share + coding.prior.astype(float)[coding.cls]).sum() - 1) < 1e-4  # class times share over all ids


def test_scores(spark):
    rng = random.Random(8)
    rows = odd_rows() + [(100 + k, prose(rng, 80)) for k in range(150)]
    out = attention_lm.query(documents(prepare(spark), rows)).collect()
    counts = Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split()
    for i, t in rows:
        if not held(i):
            counts.update([*split(t), None])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((repr(i), held(i), len(split(t)) + 1, sum(counts[x] > 0 for x in [*split(t), None]), total,
                    round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in [*split(t), None]), 6)) for i, t in rows), key=repr)
    got = sorted(((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    # the model tells the corpus' language from noise
    text = [r.score / r.n_tokens for r in out if r.held_out and r.doc_id and r.doc_id >= 100]
    noise = attention_lm.query(documents(spark, rows + [(9000 + k, " ".join(f"q{rng.randrange(10**9)}x" for _ in range(80))) for k in range(20)])).collect()
    assert np.mean(text) > np.mean([r.score / r.n_tokens for r in noise if r.doc_id and r.doc_id >= 9000])
    assert attention_lm.query(documents(spark, [])).collect() == []


def test_weights_are_fitted_on_all_training_rows(spark, monkeypatch):
    rows = [(k, f"text number {k} of a few") for k in range(20)] + [(None, "without an id"), (3, "text number 3 of a few")]
    training = sorted(t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2)
    seen, fit = [], attention_lm.fit

    def spied(texts, coding, *rest):
        seen.extend(r.text.decode() for r in texts.collect())
        w = fit(texts, coding, *rest)
        assert any((w[k] != x).any() for k, x in attention_lm.start_weights(coding.prior).items())
        return w
    monkeypatch.setattr(attention_lm, "fit", spied)
    assert len(attention_lm.query(documents(prepare(spark), rows)).collect()) == len(rows)
    assert sorted(seen) == training


def _labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        t = prose(rng, rng.randint(40, 120)) + "."
        rows.append((k, t.upper().replace(" ", "!! ") if bad and k % 2 else t.replace(" ", "$$ # ") if bad else t))
        labels.append((k, int(not bad), 0))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = _labelled(random.Random(9), 500)
    y = dict((k, v) for k, v, _ in labels)
    table = prepare(spark).createDataFrame(labels + labels[:5] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_gam.query(documents(spark, rows + [r for r in odd_rows() if r[0] not in y]), table).collect()
    held = [r for r in out if r.held_out and r.doc_id in y]
    assert len(held) > 80 and sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) and 0 <= r.score <= 1
               and r.predicted == int(r.score >= 0.7) for r in out)
    # a held-out label changes no score
    flipped = [(k, 1 - v if zlib.crc32(str(k).encode()) % 4 == 2 else v, t) for k, v, t in labels]
    again = quality_gam.query(documents(spark, rows), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    scores = {r.doc_id: r.score for r in out if r.doc_id in y}
    assert all(abs(scores[r.doc_id] - r.score) < 1e-12 for r in again)


def test_quality_without_labels(spark):
    none = prepare(spark).createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_gam.query(documents(spark, odd_rows()), none).collect()
    assert len(out) == len(odd_rows()) and {r.score for r in out} == {0.5}
    assert quality_gam.query(documents(spark, []), none).collect() == []


def test_tables_of_the_model():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction only
    m = quality_gam.fit(x[:3000], y[:3000])
    assert {0, 1} in [set(p) for p, _ in m.pairs]
    assert ((m.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.85
