"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and shares of a whole text (one byte histogram per text, words, lines, runs);
label, language, source and id are no inputs. Fitting bins each feature at quantiles and boosts
cyclically: in every round each feature in turn gets a shallow regression tree over its own bins
(two levels, fitted to gradients and hessians of the log loss), added to that feature's lookup table.
Then the feature pairs are ranked by the gain of one tree on both features over the residuals, and the
best pairs are boosted cyclically in two-dimensional tables. A score is the sum of the intercept and one bin per table,
looked up for a whole batch at a time, through the logistic function.

Fitting takes at most MAX_TRAIN labelled rows, those with the smallest hashes of the id
(a documented bound: 20,000 rows of some 30 numbers, fitted on the driver). Everything else covers all rows.

Defined cases: a null text counts as empty; a null id is not in the training rows and counts as not held out;
several labels of one id count by their mean, rounded up; null labels are ignored; with no labelled
row, or one class only, every score is the smoothed share of label 1; no rows give no rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_id, staged

MAX_TRAIN, THRESHOLD = 20_000, 0.7
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, N_PAIRS, RATE, L2, LEAST = 32, 8, 60, 25, 6, 0.15, 1.0, 8

_BYTES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 10, 11, 12, 13), "high": range(128, 256),
    "stop": b".!?", "comma": b",;:", "symbol": b"#*$%&|<>", "bar": b"|", "bang": b"!", "quote": b"\"'()[]{}", "other": b"@/\\^_`~+=-",
}
_MASKS = np.zeros((256, len(_BYTES)))
for _k, _codes in enumerate(_BYTES.values()):
    _MASKS[list(_codes), _k] = 1
_RUN = re.compile(rb"(.)\1{3,}", re.DOTALL)
FEATURES = [*(f"share_{k}" for k in _BYTES), "log_words", "word_bytes", "distinct_words", "top_word", "short_words", "long_words", "caps_words",
            "log_lines", "words_per_line", "distinct_lines", "lines_with_stop", "sentence_words", "bars_per_line", "runs", "repeated_pairs"]


def features(text: bytes | None) -> list[float]:
    """The numbers FEATURES of one whole text."""
    text = text or b""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(len(text), 1)
    counts = hist @ _MASKS
    words = text.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kinds, most = len(set(words)), 0
    if words:
        ids = np.fromiter(map(hash, words), np.int64, len(words))
        _, times = np.unique(ids, return_counts=True)
        most = int(times.max())
        pairs = ids[:-1] * 1000003 + ids[1:]
        repeated = 1 - len(np.unique(pairs)) / max(len(pairs), 1) if len(pairs) else 0.0
    else:
        repeated = 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    return [*(counts / n).tolist(), np.log1p(len(words)), lengths.sum() / w, kinds / w, most / w, float((lengths <= 2).sum()) / w, float((lengths >= 12).sum()) / w,
            sum(map(bytes.isupper, words)) / w, np.log1p(len(lines)), len(words) / k, len(set(lines)) / k,
            sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, w / (1 + counts[5]), counts[8] / k, sum(len(m[0]) for m in _RUN.finditer(text)) / n, repeated]


def _tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values over ordered bins of a regression tree of ``depth`` levels of splits."""
    value = np.full(len(grad), -grad.sum() / (hess.sum() + L2))
    if depth == 0 or len(grad) < 2:
        return value
    g, h, r = np.cumsum(grad), np.cumsum(hess), np.cumsum(rows)
    left, right = slice(None, -1), -1
    gain = g[left] ** 2 / (h[left] + L2) + (g[right] - g[left]) ** 2 / (h[right] - h[left] + L2)
    gain[(r[left] < LEAST) | (r[right] - r[left] < LEAST)] = -np.inf
    cut = int(np.argmax(gain)) + 1
    if not gain[cut - 1] > g[right] ** 2 / (h[right] + L2) + 1e-9:
        return value
    return np.concatenate([_tree(grad[:cut], hess[:cut], rows[:cut], depth - 1), _tree(grad[cut:], hess[cut:], rows[cut:], depth - 1)])


def _tree2(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a grid: one split of the first axis, then one of the second on each side; and its gain."""
    def along(g, h, r):  # best split of the second axis
        g, h, r = np.cumsum(g), np.cumsum(h), np.cumsum(r)
        base = g[-1] ** 2 / (h[-1] + L2)
        gain = g[:-1] ** 2 / (h[:-1] + L2) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + L2)
        gain[(r[:-1] < LEAST) | (r[-1] - r[:-1] < LEAST)] = -np.inf
        cut = int(np.argmax(gain)) + 1 if len(gain) else 0
        if not cut or not gain[cut - 1] > base:
            return np.full(len(g), -g[-1] / (h[-1] + L2)), base
        return np.repeat([-g[cut - 1] / (h[cut - 1] + L2), -(g[-1] - g[cut - 1]) / (h[-1] - h[cut - 1] + L2)], [cut, len(g) - cut]), float(gain[cut - 1])
    best, found = -np.inf, np.zeros_like(grad)
    for cut in range(1, len(grad)):
        up, a = along(grad[:cut].sum(0), hess[:cut].sum(0), rows[:cut].sum(0))
        down, b = along(grad[cut:].sum(0), hess[cut:].sum(0), rows[cut:].sum(0))
        if a + b > best:
            best, found = a + b, np.concatenate([np.tile(up, (cut, 1)), np.tile(down, (len(grad) - cut, 1))])
    return found, best


class Model:
    """Bin edges, an intercept, one table per feature and one per pair."""

    def __init__(self, edges, intercept, tables, pair_edges, pairs):
        self.edges, self.intercept, self.tables, self.pair_edges, self.pairs = edges, intercept, tables, pair_edges, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(c) else np.empty(0) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting over the features, then over the best pairs. ``y`` is 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    edges, pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(edges, start, tables, pair_edges, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    total = np.full(len(y), start)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, p * (1 - p)

    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]
    for _ in range(ROUNDS):
        for b, t, r in zip(bins, tables, rows, strict=True):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), r)
            t += step
            total += step[b]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(pair_edges, x.T, strict=True)]
    shape = [len(e) + 1 for e in pair_edges]
    grid = lambda i, j, v=None: np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j]).astype(float)
    g, h = slopes()
    gains = sorted(((_tree2(grid(i, j, g), grid(i, j, h), grid(i, j))[1], i, j) for i, j in combinations(range(len(edges)), 2) if min(shape[i], shape[j]) > 1), reverse=True)
    model.pairs = [((i, j), np.zeros((shape[i], shape[j]))) for _, i, j in gains[:N_PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in model.pairs:
            g, h = slopes()
            step = RATE * _tree2(grid(i, j, g), grid(i, j, h), grid(i, j))[0]
            t += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(key: Column) -> Column:
    return crc32_id(key) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_TRAIN) -> Model:
    """A model of ``label`` from the labelled rows that are not held out, at most ``max_rows`` of them."""
    y = (labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
         .filter(~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    y = staged(y.orderBy(F.xxhash64("id"), "id").limit(max_rows), "labels")  # bounded by max_rows
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")).join(F.broadcast(y), "id")

    def numbers(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [features(t) for t in b["text"]]})

    # a document that occurs in many rows counts once: the rows collected are bounded as well
    found = rows.mapInPandas(numbers, "id long, y int, x array<double>").groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("id")
    return fit(np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), found["y"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the column ``score``: the model's probability of label 1."""
    @F.pandas_udf("double")
    def udf(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(x) for x in t], dtype=float).reshape(-1, len(FEATURES))))
    return docs.select("*", udf(F.col(f"`{text}`").cast("binary")).alias(score))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether it is held out of the fit, its score and the predicted label."""
    out = scored(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(docs, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
