"""Importance resampling towards a target: array-scored weights, ranks by parallel sorting by regular sampling.

Features are runs of 1 to 2 consecutive words, hashed into ``BUCKETS`` buckets by CRC-32. Two passes over the texts, in
numpy on the bytes of an Arrow batch: the first counts the buckets (one array per task, summed by Spark into at most
``BUCKETS`` rows), the second looks every feature's gain up in one array and writes a document's weight and its score,
the weight plus Gumbel noise from its id. Of the documents with ``MIN_WORDS`` words or more, the best ``SHARE`` percent
get ranks by sorting with regular samples:

1. every task of the second pass sorts its documents and writes them as a run; a row's place in its run is stored;
2. every ``step``-th row of a run is a sample (from a start that follows from the run's number, so that runs shorter
   than the step are represented); the sorted samples give splitters at regular places. Rows that tie in score and id are
   ordered by run and place, so equal rows never swell a segment;
3. counts per segment, added up in order, say where a segment's ranks begin and which segments hold drawn rows;
4. only those are exchanged, one partition per segment, merged there by a sort, and numbered from the segment's start.

The driver holds the gains, at most about ``SAMPLES`` samples and a count per segment, whatever the corpus.

Defined cases: a null text has no words; an empty text or one without words has weight 0; a null id counts as the empty text
in the noise and comes after other ids; repeated rows are documents of their own with ranks of their own; no target text,
or no document, leaves every gain to the smoothing; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, staged

BUCKETS, SEED, SHARE, MIN_WORDS = 10_000, 7, 25, 20
#: Samples that the splitters are taken from; rows that a segment should hold at most; segments at most.
SAMPLES, SEGMENT_ROWS, MAX_SEGMENTS = 65_536, 1_000_000, 16_384
#: Bytes of a word that are hashed in array steps; the rest of a longer word is hashed by itself.
LONG = 48

# Fixed values of CRC-32 (reflected polynomial), lower case of ASCII, and the bytes that words are made of
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _feed(register: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after the words at ``start`` were fed to them, all words a byte at a time; longest first."""
    register = register.copy()
    alive = np.searchsorted(-size, -np.arange(min(LONG, size[0] if len(size) else 0)))  # words longer than k bytes
    for k, n in enumerate(alive):
        register[:n] = _CRC[(register[:n] ^ data[start[:n] + k]) & 255] ^ register[:n] >> 8
    for i in range(int(np.searchsorted(-size, -LONG))):
        rest = data[start[i] + LONG:start[i] + size[i]].tobytes()
        register[i] = ~np.uint32(zlib.crc32(rest, int(~register[i])))
    return register


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, bucket of each feature, words of each document) of the texts that lie in ``data``
    between ``offsets``."""
    data = _FOLD[data]
    inside = _IN_WORD[data]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[edge] = after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    size = np.flatnonzero(inside & ~after) + 1 - start
    doc = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(doc, minlength=len(offsets) - 1)
    order = np.argsort(-size, kind="stable")
    single = np.empty(len(start), dtype=np.uint32)
    single[order] = _feed(np.full(len(start), 0xFFFFFFFF, dtype=np.uint32), data, start[order], size[order])
    pair = order[(order > 0) & (doc[order] == doc[order - 1])]  # second words of pairs, longest first
    register = single[pair - 1]
    double = _feed(_CRC[(register ^ 32) & 255] ^ register >> 8, data, start[pair], size[pair])
    crc = ~np.concatenate([single, double])
    return np.concatenate([doc, doc[pair]]), crc % np.uint32(buckets), words


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts and their offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            if len(b):
                total += np.bincount(features(*_texts(b.column(0)), buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    parts = texts.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: a thousandth of the smoothed log ratio of target to own share, floored."""
    n, s, t = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(own.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            doc, bucket, words = features(*_texts(b.column("text")), len(table.value))
            n = np.bincount(doc, minlength=len(b))
            total = np.bincount(doc, weights=table.value[bucket], minlength=len(b)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = np.floor(-1000 * np.log(-np.log((b.column("h").to_numpy() + 0.5) / 4294967296))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (words, n, weight, weight + noise))],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                       F.conv(F.substring(seeded, 1, 8), 16, 10).cast("long").alias("h"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


_PLACE = 2**33  # monotonically_increasing_id(): a row's partition times this, plus its place
_LAST_ID = 2**63 - 1  # null ids come last


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]


def _before(splitter: tuple[int, int | None, int]) -> Column:
    """Rows that come before a splitter."""
    score, key, at = splitter
    own, tied = F.coalesce("doc_id", F.lit(_LAST_ID)), F.lit(_LAST_ID if key is None else key)
    return (F.col("score") > score) | ((F.col("score") == score) & ((own < tied) | ((own == tied) & (F.col("at") < at))))


def _segment(splitters: list[tuple], score: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many splitters come before or at each row."""
    cut = np.array(splitters, dtype=np.int64).reshape(-1, 3).T
    own = np.arange(len(score) + cut.shape[1]) >= cut.shape[1]  # splitters first: a row equal to one follows it
    order = np.lexsort((own, np.append(cut[2], at), np.append(cut[1], key), -np.append(cut[0], score)))
    out = np.empty(len(own), dtype=np.int64)
    out[order] = np.cumsum(~own[order])
    return out[cut.shape[1]:]


def ranked(runs: DataFrame, quota: int, eligible: int) -> DataFrame:
    """``runs`` (staged: doc_id, score, at, drawable and more) with the rank of the first ``quota`` drawable rows."""
    spark = runs.sparkSession
    rows = runs.filter("drawable")
    segments = min(MAX_SEGMENTS, max(partitions(spark), math.ceil(eligible / SEGMENT_ROWS)))
    step = max(1, eligible // SAMPLES)
    run, place = F.shiftright("at", 33), F.col("at").bitwiseAND(_PLACE - 1)
    samples = rows.filter(F.pmod(place + F.pmod(F.xxhash64(run), F.lit(step)), F.lit(step)) == step - 1).select("score", "doc_id", "at")
    found = [(r.score, _LAST_ID if r.doc_id is None else r.doc_id, r.at) for r in samples.orderBy(*_order()).collect()]
    splitters = sorted({found[k * len(found) // segments] for k in range(1, segments)}, key=lambda x: (-x[0], *x[1:])) if found else []

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        key = b.column("doc_id").fill_null(_LAST_ID).to_numpy()
        return _segment(splitters, b.column("score").to_numpy(), key, b.column("at").to_numpy())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(splitters) + 1, dtype=np.int64)
        for b in batches:
            total += np.bincount(numbers(b), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["segment", "n"])
    held = np.zeros(len(splitters) + 1, dtype=np.int64)
    for r in rows.select("score", "doc_id", "at").mapInArrow(count, "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).collect():
        held[r.segment] = r.n
    begin = np.cumsum(held) - held
    used = int(np.searchsorted(begin, quota))  # segments that begin before the quota is full
    if not used:
        return runs.withColumn("rank", F.lit(None).cast("long"))
    drawable = F.col("drawable") & (_before(splitters[used - 1]) if used <= len(splitters) else F.lit(True))
    schema = runs.schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers(b))], [*b.schema.names, "segment"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            segment = b.column("segment").to_numpy()
            rank = np.empty(len(b), dtype=np.int64)
            for s in np.unique(segment).tolist():
                at = np.flatnonzero(segment == s)
                first = seen.get(s, int(begin[s]))
                rank[at] = first + 1 + np.arange(len(at))
                seen[s] = first + len(at)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rank, mask=rank > quota)], [*b.schema.names[:-1], "rank"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    exchanged = rows.filter(drawable).mapInArrow(label, f"{fields}, segment long").repartitionById(used, F.col("segment").cast("int"))
    merged = exchanged.sortWithinPartitions("segment", *_order()).mapInArrow(number, f"{fields}, rank long")
    return merged.unionByName(runs.filter(~drawable).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; the drawn ones have a rank."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    scored = weights(docs, gain, key, text, seed).withColumn("drawable", F.col("n_words") >= min_words)
    run = scored.sortWithinPartitions(F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features").withColumn("at", F.monotonically_increasing_id())
    runs = staged(run, "resampling-runs")
    eligible = runs.filter("drawable").count()
    return ranked(runs, share * eligible // 100, eligible).drop("drawable", "at")


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every document's features, weight and score, and the rank of the quarter that is drawn."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = f"""
WITH crc(t) AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS k FROM documents
), target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), own AS (
  SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), theirs AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM target
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(f)), lambda i: ('0x' || substring(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
                            lambda r, b: xor(t[(xor(r, b) % 256) + 1], r // 256)), 4294967295) % {BUCKETS} AS b
  FROM (SELECT f FROM own UNION SELECT f FROM theirs), crc
), s AS (SELECT b, count(*) AS n FROM own JOIN hashed USING (f) GROUP BY b
), t AS (SELECT b, count(*) AS n FROM theirs JOIN hashed USING (f) GROUP BY b
), gain AS (
  SELECT b.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
                              / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM (SELECT unnest(range({BUCKETS})) AS b) b LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), weight AS (
  SELECT k, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN hashed USING (f) JOIN gain USING (b) GROUP BY k
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {MIN_WORDS} AS drawable,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weight USING (k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY drawable ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, {SHARE} * count(*) OVER (PARTITION BY drawable) // 100 AS quota FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN drawable AND r <= quota THEN r END AS rank FROM placed
"""
