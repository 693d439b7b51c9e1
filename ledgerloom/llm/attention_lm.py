"""LM scoring with a causal self-attention model over subword ids, trained in numpy.

Corpus counts cover every training document: documents are dealt to chunks by hash (about CHUNK_BYTES of
text each), each chunk gives its distinct words with their training counts, and these are added up by
word. The counts go back to the chunks by a join on (chunk, word), so a task meets the words of
its chunk only, and no vocabulary is broadcast or collected.

The model reads subword ids (public byte-level BPE ranks, each word encoded with a space before it) and predicts
the class of the next id; an id's share of its class comes from the subword counts of the whole training corpus, CLASSES
classes of about equal mass in the order of frequency. One attention layer: embeddings of the INPUTS most
frequent ids (the others by class), causal attention with a bias by distance, a residual tanh, a softmax over the classes. Its
weights are fitted on the whole texts of all training documents: trainers fit the weights on their own rows,
and the weights are averaged, ROUNDS times.

Scoring cuts each text into overlapping windows of WINDOW ids, the last STRIDE of which are
scored, so that every id, and the end, is scored once with WINDOW - STRIDE to WINDOW - 1 ids before it.

Defined cases: a null text counts as empty and is scored by its end alone; a null id is in training;
repeated rows count and are scored as often as they occur; with no training row the counts are 0 and the model is uniform;
no rows give no rows.
"""

from __future__ import annotations

import base64
import struct
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_id, partitions, staged

WINDOW, STRIDE, WIDTH, CLASSES, INPUTS = 32, 24, 16, 64, 2048
CHUNK_BYTES, ROUNDS, BATCH, LEARN = 12 << 20, 2, 32, 0.01
CACHE_WORDS = 500_000


class _Subwords(dict):
    """Word (bytes) -> its ids as little-endian 32-bit integers; cleared when it holds CACHE_WORDS words."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1  # the end has this id
        self.encode = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        b = self[word] = struct.pack(f"<{len(ids := self.encode(' ' + word.decode('utf-8', 'replace')))}i", *ids)
        return b


@lru_cache(maxsize=2)
def subwords(path: str, pattern: str) -> _Subwords:
    """The encoder of this worker process."""
    return _Subwords(path, pattern)


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def sequence(encoder: _Subwords, found: list[bytes]) -> np.ndarray:
    """The ids of a text between two ends."""
    end = np.array([encoder.size], dtype="<i4").tobytes()
    return np.frombuffer(b"".join([end, *map(encoder.__getitem__, found), end]), dtype="<i4")


class Coding:
    """From subword counts: each id's input number, class and log share of its class."""

    def __init__(self, counts: np.ndarray):
        c = counts + 1.0
        order = np.argsort(-c, kind="stable")
        mass = np.cumsum(c[order]) - c[order] / 2
        self.cls = np.empty(len(c), dtype=np.int64)
        self.cls[order] = np.minimum((mass / c.sum() * CLASSES).astype(np.int64), CLASSES - 1)
        total = np.bincount(self.cls, c, CLASSES)
        self.share = np.log(c / total[self.cls])
        self.prior = np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32)
        self.inp = INPUTS + self.cls
        self.inp[order[:INPUTS]] = np.arange(min(INPUTS, len(c)))


def start_weights(prior: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    draw = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
    w = {"e": draw(INPUTS + CLASSES, WIDTH), "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "o": draw(WIDTH, WIDTH),
         "rel": np.zeros(WINDOW, dtype=np.float32), "u": np.zeros((WIDTH, CLASSES), dtype=np.float32), "b": prior.copy()}
    return w


_AT, _Q = np.arange(WINDOW), np.arange(WINDOW - STRIDE, WINDOW)
_BACK = _Q[:, None] - _AT[None]  # how far a key is behind a query
_CAUSAL = np.where(_BACK >= 0, 0.0, -1e9).astype(np.float32)


def _forward(w: dict, ids: np.ndarray, pad: np.ndarray) -> tuple:
    """``ids`` (n, WINDOW) input numbers, ``pad`` where there is none -> everything up to the class log probabilities of the last STRIDE places."""
    x = w["e"][ids]
    q, k, v = x[:, WINDOW - STRIDE:] @ w["q"], x @ w["k"], x @ w["v"]
    s = q @ k.transpose(0, 2, 1)
    s *= np.float32(WIDTH ** -0.5)
    s += _CAUSAL + w["rel"][np.maximum(_BACK, 0)]
    if pad.any():
        s += np.where(pad, np.float32(-1e9), np.float32(0))[:, None]
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    o = s @ v
    h = np.tanh(x[:, WINDOW - STRIDE:] + o @ w["o"])
    z = h.reshape(-1, WIDTH) @ w["u"] + w["b"]
    z -= z.max(axis=1, keepdims=True)
    lse = np.log(np.exp(z).sum(axis=1, keepdims=True))
    z -= lse
    return x, q, k, v, s, o, h, z


def scoring_tables(w: dict) -> dict[str, np.ndarray]:
    """The weights with all projections of the embeddings taken once per input number."""
    e = w["e"]
    return {"e": e, "q": e @ w["q"] * np.float32(WIDTH ** -0.5), "k": e @ w["k"], "v": e @ w["v"] @ w["o"],
            "bias": _CAUSAL + w["rel"][np.maximum(_BACK, 0)], "u": w["u"], "b": w["b"]}


def _target_log(t: dict, ids: np.ndarray, pad: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the target classes (n * STRIDE) at the last STRIDE places of each window."""
    own = ids[:, WINDOW - STRIDE:]
    s = t["q"][own] @ t["k"][ids].transpose(0, 2, 1)
    s += t["bias"]
    if pad.any():
        s += np.where(pad, np.float32(-1e9), np.float32(0))[:, None]
    if s.max() > 60:
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    h = s @ t["v"][ids]
    h /= s.sum(axis=2, keepdims=True)
    h += t["e"][own]
    np.tanh(h, out=h)
    z = h.reshape(-1, WIDTH) @ t["u"]
    z += t["b"]
    if z.max() > 60:
        z -= z.max(axis=1, keepdims=True)
    got = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    return got - np.log(z.sum(axis=1))


def _gradients(w: dict, ids: np.ndarray, pad: np.ndarray, target: np.ndarray, real: np.ndarray) -> dict:
    """Gradients of the mean log loss over the ``real`` places (n, STRIDE)."""
    x, q, k, v, a, o, h, z = _forward(w, ids, pad)
    d = np.exp(z)
    d[np.arange(len(d)), target.ravel()] -= 1
    d *= (real.ravel() / max(real.sum(), 1)).astype(np.float32)[:, None]
    flat = h.reshape(-1, WIDTH)
    g = {"u": flat.T @ d, "b": d.sum(axis=0)}
    dp = (d @ w["u"].T).reshape(h.shape) * (1 - h * h)
    g["o"] = np.tensordot(o, dp, axes=((0, 1), (0, 1)))
    do = dp @ w["o"].T
    dv = a.transpose(0, 2, 1) @ do
    da = do @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    g["rel"] = np.bincount(np.maximum(_BACK, 0).ravel(), np.where(_BACK >= 0, ds.sum(axis=0), 0).ravel(), WINDOW).astype(np.float32)
    ds *= np.float32(WIDTH ** -0.5)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    xq = x[:, WINDOW - STRIDE:]
    g["q"], g["k"], g["v"] = (np.tensordot(m, n, axes=((0, 1), (0, 1))) for m, n in ((xq, dq), (x, dk), (x, dv)))
    dx = dk @ w["k"].T + dv @ w["v"].T
    dx[:, WINDOW - STRIDE:] += dp + dq @ w["q"].T
    g["e"] = np.zeros_like(w["e"])
    dx *= ~pad[:, :, None]
    places = ids.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
    g["e"] = np.bincount(places.ravel(), dx.ravel(), w["e"].size).reshape(w["e"].shape).astype(w["e"].dtype)
    return g


def windows(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that begin at ``starts`` of one array with ``sizes`` inputs each: the places (n, WINDOW) of each window's
    inputs, where they lie outside the text, and the text of each window."""
    count = -(-sizes // STRIDE)
    owner = np.repeat(np.arange(len(sizes)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (starts[owner] + step * STRIDE - (WINDOW - STRIDE))[:, None] + _AT
    pad = (at < starts[owner][:, None]) | (at >= (starts + sizes)[owner][:, None])
    return at, pad, owner


def log_probability(w: dict, coding: Coding, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log probability of each sequence (its ids between two ends); ``w`` from ``scoring_tables``."""
    sizes = np.array([len(t) - 1 for t in texts])
    ids = np.concatenate([t[:-1] for t in texts])
    nxt = np.concatenate([t[1:] for t in texts])
    inp, cls, share = coding.inp[ids], coding.cls[nxt], coding.share[nxt]
    starts = np.cumsum(sizes) - sizes
    at, pad, owner = windows(starts, sizes)
    out = np.bincount(np.repeat(np.arange(len(sizes)), sizes), share, len(sizes))
    for k in range(0, len(at), 160):  # so many windows stay in cache
        a, p, who = at[k:k + 160], pad[k:k + 160], owner[k:k + 160]
        a = np.where(p, 0, a) if p.any() else a
        places = a[:, WINDOW - STRIDE:]
        got = _target_log(w, inp[a], p, cls[places].ravel()).reshape(places.shape)
        if p.any():
            got = np.where(p[:, WINDOW - STRIDE:], 0, got)
        out += np.bincount(who, got.sum(axis=1, dtype=np.float64), len(sizes))
    return out


def train_on(w: dict, coding: Coding, texts: list[np.ndarray], seed: int) -> dict:
    """One pass of Adam over the texts' windows, in an order given by ``seed``."""
    if not texts:
        return w
    sizes = np.array([len(t) - 1 for t in texts])
    ids = np.concatenate([t[:-1] for t in texts])
    nxt = np.concatenate([t[1:] for t in texts])
    at, pad, _ = windows(np.cumsum(sizes) - sizes, sizes)
    order = np.random.default_rng(seed).permutation(len(at))
    m, s = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    for t, k in enumerate(range(0, len(order), BATCH), 1):
        o = order[k:k + BATCH]
        p = pad[o]
        a = np.where(p, 0, at[o])
        g = _gradients(w, coding.inp[ids[a]], p, coding.cls[nxt[a[:, WINDOW - STRIDE:]]], ~p[:, WINDOW - STRIDE:])
        for n, x in g.items():
            m[n] += 0.1 * (x - m[n])
            s[n] += 0.01 * (x * x - s[n])
            w[n] -= LEARN * (m[n] / (1 - 0.9 ** t)) / (np.sqrt(s[n] / (1 - 0.99 ** t)) + 1e-6)
    return w


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for n in sorted(like):
        size = like[n].size
        out[n] = flat[at:at + size].reshape(like[n].shape).astype(np.float32)
        at += size
    return out


def fit(texts: DataFrame, coding: Coding, path: str, pattern: str) -> dict:
    """Weights fitted on the column ``text`` (binary) of ``texts``: trainers by partition, averaged by weight number."""
    w = start_weights(coding.prior)
    texts = texts.select("text").coalesce(max(1, partitions(texts.sparkSession) // 2))  # read again in each round, neither shuffled nor staged
    for r in range(ROUNDS):
        def trainer(batches, w=w, r=r):
            enc = subwords(path, pattern)
            # a trainer takes its rows in slices, so its memory does not grow with them
            mine, seen, n = {k: x.copy() for k, x in w.items()}, 0, 0
            for b in batches:
                seqs = [sequence(enc, words(t)) for t in b["text"]]
                mine = train_on(mine, coding, seqs, 1000 * r + n)
                seen += sum(map(len, seqs))
                n += 1
            if seen:
                flat = _flat(mine)
                yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat.astype(float) * seen, "n": np.full(len(flat), seen)})
        got = texts.mapInPandas(trainer, "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()  # a row per weight
        if len(got):
            w = _shaped(got.sort_values("i")["x"].to_numpy(), w)
    return w


def scored(docs: DataFrame, path: str, pattern: str, training, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out (not ``training``), n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), (~training).alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held_out")).cast("long"))).first()
    n_chunks, n_train = max(1, -(-(size[0] or 0) // CHUNK_BYTES)), size[1] or 0
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)).cast("long"))

    def chunk_words(batches):
        """Distinct words of each run of rows of one chunk, with their training counts; rows are sorted by chunk."""
        at, held, seen = None, Counter(), set()
        def out():
            every = [*held, *(seen - held.keys())]
            return pd.DataFrame({"chunk": np.full(len(every), at), "word": every, "n": [*held.values(), *[0] * (len(every) - len(held))]})
        for b in batches:
            for c, h, t in zip(b["chunk"], b["held_out"], b["text"], strict=True):
                if c != at or len(held) + len(seen) > 1_500_000:  # a word may then come in two rows, which are added up
                    if held or seen:
                        yield out()
                    at, held, seen = c, Counter(), set()
                (seen if h else held).update(words(t))
        if held or seen:
            yield out()

    dealt = rows.repartition("chunk").sortWithinPartitions("chunk")
    met = staged(dealt.mapInPandas(chunk_words, "chunk long, word binary, n long"), "words")
    counts = staged(met.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    total, distinct = (total or 0) + n_train, (distinct or 0) + (n_train > 0)

    def subword_counts(batches):
        enc, n = subwords(path, pattern), None
        n = np.zeros(enc.size + 1)
        for b in batches:
            seqs = list(map(enc.__getitem__, b["word"]))
            n += np.bincount(np.frombuffer(b"".join(seqs), "<i4"), np.repeat(b["c"].to_numpy(float), [len(x) // 4 for x in seqs]), len(n))
        some = np.flatnonzero(n)
        yield pd.DataFrame({"i": some, "n": n[some].astype(np.int64)})

    per_id = counts.filter("c > 0").mapInPandas(subword_counts, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # at most one row per id
    with open(path, "rb") as f:
        size_of = sum(1 for _ in f)
    table = np.zeros(size_of + 1)
    for i, n in per_id:
        table[i] = n
    table[size_of] = n_train
    coding = Coding(table)
    w = scoring_tables(fit(rows.filter(~F.col("held_out")), coding, path, pattern))
    low = float(np.log10(total + distinct + 1))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        enc = subwords(path, pattern)
        c = dict(zip(right["word"], right["c"].tolist(), strict=True))
        n_tokens, n_known, base, model = [], [], [], []
        for k in range(0, len(left), 200):
            found = [words(t) for t in left["text"].iloc[k:k + 200]]
            for ws in found:
                x = np.fromiter(map(c.__getitem__, ws), np.float64, len(ws))
                n_tokens.append(len(ws) + 1)
                n_known.append(int(np.count_nonzero(x)) + (n_train > 0))
                base.append(float(np.log10(x + 1).sum() + np.log10(n_train + 1) - (len(ws) + 1) * low))
            model.append(log_probability(w, coding, [sequence(enc, ws) for ws in found]) / np.log(10))
        return pd.DataFrame({"id": left["id"].astype("Int64"), "held_out": left["held_out"], "n_tokens": n_tokens, "n_known": n_known,
                             "train_tokens": total, "base_score": base, "score": np.concatenate(model) if model else []})

    mine = met.select("chunk", "word").join(counts, "word")
    return rows.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(
        score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(docs: DataFrame) -> DataFrame:
    """One row per document: its tokens, the base score from the training counts, and the model's log10 probability."""
    import public_tokenizers as p
    return scored(docs.select("doc_id", "text"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, crc32_id(F.col("doc_id")) % 7 != 2).withColumnRenamed("id", "doc_id")
