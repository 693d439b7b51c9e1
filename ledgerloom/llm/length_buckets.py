"""Packing into optimal length buckets.

The histogram of document lengths over all documents is a distributed aggregate; its rows are the
distinct lengths, so its size follows the longest text and not the number of documents. Dynamic
programming over it picks the bucket boundaries of least padding: the cost of one bucket for the
lengths i..j is (documents in i..j) * length j - (tokens in i..j), which satisfies the quadrangle
inequality, so each of the layers is solved by divide and conquer and stays exact. A document goes
to the smallest boundary that holds it. Batches of one bucket hold ``budget // boundary`` documents
(one, if the boundary is over the budget), each padded to the boundary.

Numbering inside a bucket: rows are dealt by hash into blocks of bounded size, numbered inside
their block by a window and shifted by the count of the blocks before, so that no window holds a
whole bucket.

Defined cases: a null or empty text has 0 tokens and goes to the smallest bucket; equal lengths
share a bucket; rows are numbered by id, then text hash; with fewer distinct lengths than buckets each length is
a boundary; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

N_BUCKETS, BUDGET, BLOCK_ROWS = 16, 8192, 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper boundaries of at most ``n_buckets`` buckets with the least total padding over the
    histogram (``lengths`` ascending and distinct)."""
    m = len(lengths)
    if m <= n_buckets:
        return [int(x) for x in lengths]
    size = np.maximum(lengths, 1).astype(np.float64)
    docs = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = size * docs[1:]  # one bucket over lengths 0..j; the tokens are the same for every choice
    came = []
    for _ in range(1, n_buckets):
        nxt, cut = np.empty(m), np.zeros(m, dtype=np.int64)
        todo = [(0, m - 1, 0, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j) + 1)  # the bucket of j starts at i; i == 0: it is the only one
            cost = np.where(i > 0, best[i - 1], 0.0) + size[j] * (docs[j + 1] - docs[i])
            k = int(np.argmin(cost))
            nxt[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = nxt
        came.append(cut)
    out, j = [int(lengths[m - 1])], m - 1
    for cut in reversed(came):
        if cut[j] == 0:
            break
        j = int(cut[j]) - 1
        out.append(int(lengths[j]))
    return out[::-1]


def pack(docs: DataFrame, length: Column, order: Column, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Columns of ``docs`` with pack_tokens, pack_bucket, pack_length (the padded length), pack_batch
    (numbered from 0 in each bucket) and pack_slot (place in the batch). ``order`` breaks ties."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = staged(docs.select(*own, length.cast("long").alias("pack_tokens"), order.alias("__o")), "lengths")
    hist = rows.groupBy("pack_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("pack_tokens")
    bounds = boundaries(hist["pack_tokens"].to_numpy(np.int64), hist["n"].to_numpy(np.int64), n_buckets) if len(hist) else [0]
    held = np.searchsorted(bounds, hist["pack_tokens"].to_numpy(np.int64))
    most = int(np.bincount(held, weights=hist["n"].to_numpy(float)).max()) if len(hist) else 0
    edges = F.array(*(F.lit(b).cast("long") for b in bounds))
    bucket = F.size(F.filter(edges, lambda b: b < F.col("pack_tokens")))
    n_blocks = max(1, -(-most // BLOCK_ROWS))
    rows = rows.select(*own, "pack_tokens", "__o", bucket.alias("pack_bucket"),
                       F.pmod(F.xxhash64("__o"), F.lit(n_blocks)).alias("__block"))
    counts = rows.groupBy("pack_bucket", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("pack_bucket").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.select("pack_bucket", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "starts")
    inside = Window.partitionBy("pack_bucket", "__block").orderBy("__o")
    rows = rows.withColumn("__r", F.row_number().over(inside) - 1).join(starts, ["pack_bucket", "__block"])
    padded = F.element_at(edges, F.col("pack_bucket") + 1)
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(padded, F.lit(1))), F.lit(1)).cast("long")
    at = F.col("__start") + F.col("__r")
    return rows.select(*own, "pack_tokens", "pack_bucket", padded.alias("pack_length"),
                       F.floor(at / room).cast("long").alias("pack_batch"), (at % room).cast("long").alias("pack_slot"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: its words, bucket, padded length, batch and place in the batch."""
    t = F.col("text")
    rows = docs.select("doc_id", n_words(t).alias("n"), F.xxhash64(t).alias("h"))
    out = pack(rows, F.col("n"), F.struct("doc_id", "h"))
    return out.select("doc_id", *(F.col(f"pack_{c}").alias(c) for c in ("tokens", "bucket", "length", "batch", "slot")))
