"""Quality rules by host, with DataFrame functions only.

1. ``measure``: word, symbol, line and repetition counts of every whole text, and the base rules.
2. ``host_verdicts``: documents and failures per host are counted (partial aggregates: a host with
   a third of all rows is a few partial rows). The hosts' failure rates give an empirical beta
   prior by moments; each host's rate is shrunk to (failures + a) / (documents + a + b), and a
   host above ``max_rate`` is rejected.
3. ``judge``: the verdicts are joined back to the documents.

Defined cases: a null text has no words and fails the base rule (fewer than 50 words); a null
host is a host of its own; repeated rows count as often as they occur; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_up_to, let, staged, words

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_RATE = 50, 50, 0.8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _covered(starts: Column, width: int) -> Column:
    """How many positions windows of ``width`` at these sorted starts cover together."""
    gap = F.transform(starts, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - x, F.lit(width))))
    return F.aggregate(gap, F.lit(0), lambda a, x: a + x)


def _repeat_starts(hashes: Column) -> Column:
    """Sorted positions of the values that occur twice or more: values and positions are sorted
    together, then each is compared with its neighbours."""
    def flagged(s):
        same = lambda x, k: F.get(s, k)["h"] == x["h"]
        marked = F.transform(s, lambda x, k: F.when((k > 0) & same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))
    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), flagged)


def _counts(text: Column) -> Column:
    """(n_words, word_chars, n_repeat_words, failed) of a text as one struct. Each array is bound once by
    ``let``: a filter that the optimizer moves below a projection then still evaluates it once a row."""
    def of_words(w):
        n = F.size(w)
        windows = F.when(n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

        def of_windows(h):
            repeated = F.when(F.size(F.array_distinct(h)) < F.size(h), let(_repeat_starts(h), lambda p: _covered(p, 3))).otherwise(0).cast("long")
            return let(repeated, lambda r: F.struct(
                n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), r.alias("n_repeat_words"),
                ((n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).alias("base_failed")))
        return let(windows, of_windows)
    return let(words(text), of_words)


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns MEASURES added under ``prefix`` (one that no column of ``docs`` has)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*own, _counts(F.col(f"`{text}`")).alias("__c"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("__d"),
                     (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("__s"))
    place = {"n_symbols": F.col("__s"), "n_dup_lines": F.col("__d")}
    return df.select(*own, *(place.get(c, F.col(f"__c.{c}")).alias(prefix + c) for c in MEASURES))


def host_verdicts(measured: DataFrame, host: str, failed: str = "base_failed", max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, failures, rate, rejected): one row per host, ``rate`` shrunk by the prior."""
    hosts = staged(measured.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(f"`{failed}`").cast("long")).alias("failures")), "hosts")
    raw = F.col("failures") / F.col("n")
    m, v = hosts.agg(F.avg(raw), F.var_pop(raw)).first()  # two numbers
    m = m or 0.0
    strength = m * (1 - m) / v - 1 if v else 0.0
    if strength <= 0:
        strength = 1.0  # equal rates, one host, or rates of 0 and 1 only: a weak prior
    rate = (F.col("failures") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def judge(measured: DataFrame, verdicts: DataFrame, host: str, failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """``measured`` with ``kept``: neither the base rules nor the host's verdict reject it."""
    own = [F.col(f"`{c}`") for c in measured.columns]
    bad = broadcast_up_to(staged(verdicts.filter("rejected").select(F.col("host").alias("__host"), F.lit(True).alias("__bad")), "bad-hosts"), 100_000)
    return (measured.join(bad, F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left")
            .select(*own, (~F.col(f"`{failed}`") & F.col("__bad").isNull()).alias(kept)))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, whether the base rules fail, and whether it is kept."""
    measured = staged(measure(docs.select("doc_id", "source", "text")).drop("text"), "measures")
    return judge(measured, host_verdicts(measured, "source"), "source").drop("source")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
pos AS (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
tri AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, a, b, c) >= 2),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) t(k) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '{WORD}') GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS failures FROM f GROUP BY source),
p AS (SELECT avg(failures / n) AS mean, var_pop(failures / n) AS v FROM h),
s AS (SELECT mean, CASE WHEN v > 0 AND mean * (1 - mean) / v - 1 > 0 THEN mean * (1 - mean) / v - 1 ELSE 1.0 END AS k FROM p),
bad AS (SELECT source FROM h, s WHERE (failures + mean * k) / (n + k) > {MAX_RATE})
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""
