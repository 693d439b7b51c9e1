"""Line deduplication by an exact set-similarity join, with DataFrame functions only.

A line's tokens are its distinct five-word shingles (lower case; a line with fewer words is one
shingle), held as 64-bit hashes, so that equality of shingles and of short lines is equality of 64 bits (about N^2 / 2^65 wrong
pairs among N distinct ones: 7e-5 at 50 million); lines link at a Jaccard similarity of 0.75 or more. Documents are in
the order of id, then text hash. A line goes if an earlier line, of its own or another document, has an
equal or similar set.

1. All lines are tokenised and staged with the high 31 bits of each token, which the prefix filter needs; these go when
   it is done. Lines with equal sets are one class, which stands at its first line; a line that occurs everywhere is one class.
2. Rarity: all tokens of all lines are counted in CELLS hash cells; a class's tokens are ordered by
   their cell's count, then by their 31 bits, an order that all lines share. Tokens that agree in these
   stand for one another in the prefix filter, which adds candidates and loses none; verification hashes the lines
   of the candidates again and reads all 64 bits.
3. Prefix filter: similar sets share a token among the first n - ceil(0.75 n) + 1 of each. Tokens that
   only one class has in its prefix are dropped by an aggregate. Pairs under the same token pass the length filter,
   the positional filter and the bitmap filter (each token flips one of 64 bits; the bits that differ are at most as many as the tokens
   that only one of two sets has), and are verified on the whole sets.
4. A class needs one earlier match only. So each token's classes are first compared with a few
   anchors (the first one, and one chosen by hash); only classes without a match go on to all
   earlier classes under their tokens. Near copies by the thousand thus cost pairs in proportion to their number.

Defined cases: a null text has no lines and stays null; lines without a word are kept; rows that repeat
id and text share their lines' fate; a null id sorts first; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_up_to, discarded, staged

PERCENT, WIDTH, CELLS, ANCHORS = 75, 5, 1 << 16, 2
_SPACE = r"[\x20\x09-\x0D]+"


def _shingles(words: Column, hashes: Column) -> Column:
    """The set of a line from its words and their hashes: neighbours are hashed by their hashes, one value a shingle."""
    runs = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WIDTH - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, WIDTH))))
    return F.when(F.size(hashes) >= WIDTH, F.sort_array(F.array_distinct(runs))).otherwise(F.array(F.xxhash64(words)))


def _raw_lines(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(doc, text_hash, line, raw, *more) of every line that has a word."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(t).alias("text_hash"), *more, F.posexplode(F.split(t, "\n", -1)).alias("line", "raw"))
    return rows.select("doc", "text_hash", "line", F.btrim(F.lower("raw"), F.lit(" \t\r\x0b\x0c")).alias("raw"), *more).filter("raw <> ''")


def _tokenised(rows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, toks) of lines (*keep, raw)."""
    # most lines have single spaces only, which need no pattern
    odd = F.contains("raw", F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains("raw", F.lit(c))
    rows = rows.select(*keep, F.when(odd, F.split("raw", _SPACE)).otherwise(F.split("raw", " ")).alias("words"))
    rows = rows.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return rows.select(*keep, _shingles(F.col("words"), F.col("hashes")).alias("toks"))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text_hash, line, class, bits, toks) of every line that has a word; of its tokens the high 31 bits."""
    rows = _tokenised(_raw_lines(docs, key, text), "doc", "text_hash", "line")
    flip = F.aggregate("toks", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))))
    return rows.select("doc", "text_hash", "line", F.xxhash64("toks").alias("class"), flip.alias("bits"),
                       F.transform("toks", lambda t: F.shiftrightunsigned(t, 33).cast("int")).alias("toks"))


def _rarity(tokens: DataFrame) -> Column:
    """An array with the count of each cell: CELLS numbers, whatever the input's size."""
    cell = F.col("t").bitwiseAND(F.lit(CELLS - 1))
    counts = dict(tokens.select(F.explode("toks").alias("t")).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect())
    return F.split(F.lit(",".join(str(counts.get(c, 0)) for c in range(CELLS))), ",").cast("array<bigint>")


def _fits(x: str, y: str) -> Column:
    """Length, positional and bitmap filters of two postings with columns n, pos and bits, in whole numbers."""
    c = lambda a, b: F.col(f"{a}{b}")
    nx, ny = c(x, "n"), c(y, "n")
    most = F.least(nx - c(x, "pos"), ny - c(y, "pos"))  # of common tokens, if this is the first one
    apart = F.bit_count(c(x, "bits").bitwiseXOR(c(y, "bits")))  # at most the tokens that only one of them has
    return ((100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)) & ((100 + PERCENT) * most >= PERCENT * (nx + ny))
            & ((100 + PERCENT) * apart <= (100 - PERCENT) * (nx + ny)))


class _Verifier:
    def __init__(self, docs: DataFrame, key: str, text: str, classes: DataFrame):
        self.docs, self.key, self.text = docs, key, text
        self.classes, self.sets, self.tested = classes, None, None

    def _needed(self, pairs: DataFrame) -> DataFrame:
        """The whole sets (rank, toks) of the classes of the pairs, without those of earlier pairs unless there are very many."""
        ranks = staged(pairs.select(F.col("x").alias("rank")).union(pairs.select("y")).distinct(), "ranks")
        first = self.sets is None
        self._fetch(ranks if first else ranks.join(self.sets.select("rank"), "rank", "left_anti"))
        if first or ranks.limit(1_000_001).count() > 1_000_000:
            return self.sets
        return self.sets.join(F.broadcast(ranks), "rank", "left_semi")

    def _fetch(self, ranks: DataFrame) -> None:
        """The whole sets of more classes, from their first lines."""
        want = staged(self.classes.join(ranks, "rank").select("rank", F.col("first").alias("f")), "wanted")
        if want.isEmpty():
            return
        by_text = want.groupBy(F.col("f.doc").alias("__doc"), F.col("f.text_hash").alias("__hash")).agg(F.map_from_entries(F.collect_list(F.struct("f.line", "rank"))).alias("__ranks"))
        by_text = F.broadcast(by_text) if want.limit(1_000_001).count() <= 1_000_000 else by_text
        t = F.col(f"`{self.text}`")
        found = self.docs.join(by_text, F.col(f"`{self.key}`").eqNullSafe(F.col("__doc")) & (F.xxhash64(t) == F.col("__hash")))
        rows = _raw_lines(found, self.key, self.text, "__ranks").select(F.try_element_at("__ranks", F.col("line")).alias("rank"), "raw").filter("rank IS NOT NULL")
        got = staged(_tokenised(rows, "rank"), "sets")
        if not got.groupBy("rank").count().filter("count > 1").isEmpty():  # rows that repeat id and text; else the sets need no shuffle
            once = staged(got.dropDuplicates(["rank"]), "sets")
            discarded(got)
            got = once
        self.sets = got if self.sets is None else self.sets.unionByName(got)

    def matched(self, pairs: DataFrame) -> DataFrame:
        """The x of the pairs (x, y) whose sets are similar; pairs tested before are left out."""
        new = pairs.select("x", "y").distinct()
        if self.tested is not None:
            new = new.join(self.tested, ["x", "y"], "left_anti")
        new = staged(new, "pairs")
        self.tested = new if self.tested is None else self.tested.unionByName(new)
        if new.isEmpty():
            return new.select("x")
        sets = self._needed(new)
        both = (new.join(sets.select(F.col("rank").alias("x"), F.col("toks").alias("a")), "x")
                .join(sets.select(F.col("rank").alias("y"), F.col("toks").alias("b")), "y"))
        common = F.size(F.array_intersect("a", "b"))
        return staged(both.filter(100 * common >= PERCENT * (F.size("a") + F.size("b") - common)).select("x").distinct(), "matched")


def _lists(tokens: DataFrame) -> DataFrame:
    """(tok, class, n, pos) of the prefix tokens that more than one class has, from ``tokens`` (class, toks)."""
    rarity = _rarity(tokens)
    n = F.size("toks")
    # a cell's count goes with the token: the same for all lines
    ordered = F.sort_array(F.transform("toks", lambda t: F.get(rarity, t.bitwiseAND(F.lit(CELLS - 1))) * F.lit(2**31) + t))
    keep = n - F.ceil(n * PERCENT / 100).cast("int") + 1
    postings = tokens.select("class", n.alias("n"), F.posexplode(F.slice(ordered, F.lit(1), keep)).alias("pos", "tok"))
    # one shuffle by token serves the count, the join and the removal of repeated rows; the count reads
    # n and pos as well, for only an exchange of the same columns is used again
    # (both sides then also need the same filters, which the joins would add to one of them only)
    dealt = postings.filter("class IS NOT NULL AND tok IS NOT NULL").repartition("tok")
    shared = (dealt.groupBy("tok").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.min("n").alias("n"), F.min("pos").alias("p"))
              .filter("a <> b AND n > 0 AND p >= 0").select("tok"))
    return dealt.join(shared.hint("shuffle_hash"), "tok").distinct()


def later_classes(docs: DataFrame, key: str, text: str, lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(rank) of the classes that are similar to a class of a lower rank. ``lists`` of ``_lists``, ``classes`` (class, first, bits, rank)."""
    lists = staged(lists.join(classes.select("class", "rank", "bits"), "class").select("tok", "rank", "n", "pos", "bits"), "lists")
    verify = _Verifier(docs, key, text, classes)
    mine, theirs = (lists.select("tok", F.col("rank").alias(a), *(F.col(c).alias(f"{a}{c}") for c in ("n", "pos", "bits"))) for a in "xy")
    later = None
    for a in range(ANCHORS):
        rest = mine if later is None else staged(mine.join(later, "x", "left_anti"), "rest")
        open_ = theirs if a == 0 else theirs.join(rest.select("tok").distinct(), "tok", "left_semi")
        order = F.col("y") if a == 0 else F.xxhash64(F.lit(a), "y")
        anchors = open_.groupBy("tok").agg(F.min(F.struct(order.alias("o"), "y", "yn", "ypos", "ybits")).alias("m")).select("tok", "m.y", "m.yn", "m.ypos", "m.ybits")
        pairs = rest.join(anchors, "tok").filter((F.col("y") < F.col("x")) & _fits("x", "y"))
        found = verify.matched(pairs)
        later = found if later is None else later.unionByName(found)
    rest = staged(rest.join(later, "x", "left_anti"), "rest")
    pairs = rest.join(theirs, "tok").filter((F.col("y") < F.col("x")) & _fits("x", "y"))
    return later.unionByName(verify.matched(pairs)).select(F.col("x").alias("rank"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, n_words_lines, gone): for each text that loses lines, their numbers from 0."""
    whole = staged(lines(docs, key, text), "tokens")
    lists = staged(_lists(whole.select("class", "toks")), "postings")
    tokens = staged(whole.drop("toks"), "lines")
    discarded(whole)  # the largest table; nothing reads it any more
    place = F.struct("doc", "text_hash", "line")
    first = tokens.groupBy("class").agg(F.min(place).alias("first"), F.min("bits").alias("bits"))
    # numbers in the order of the first lines: the sort's ranges, and rows within them, are numbered upwards
    classes = staged(first.orderBy("first").select("class", "first", "bits", F.monotonically_increasing_id().alias("rank")), "classes")
    later = later_classes(docs, key, text, lists, classes)
    verdict = classes.join(later.withColumn("later", F.lit(True)), "rank", "left").select("class", "first", "later")
    rows = tokens.select("doc", "text_hash", "line", "class").distinct().join(verdict, "class")
    gone = F.col("later").isNotNull() | ~place.eqNullSafe(F.col("first"))
    per_text = rows.groupBy("doc", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(gone, F.col("line"))).alias("gone"))
    return staged(per_text.filter(F.size("gone") > 0), "removed")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "dedup_") -> DataFrame:
    """``docs`` with the text less its repeated lines, and the columns lines (that have a word, 0 for a
    text that loses none) and removed (how many went) under ``prefix``."""
    own = [F.col(f"`{c}`") if c != text else F.col("__text").alias(text) for c in docs.columns]
    gone = broadcast_up_to(removed_lines(docs, key, text), 200_000)
    t = F.col(f"`{text}`")
    left = F.array_join(F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    rows = docs.join(gone.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("n").alias("__n"), F.col("gone").alias("__gone")),
                     F.col(f"`{key}`").eqNullSafe(F.col("__doc")) & (F.xxhash64(t) == F.col("__hash")), "left")
    rows = rows.withColumn("__text", F.when(F.col("__gone").isNull(), t).otherwise(left))
    return rows.select(*own, F.coalesce("__n", F.lit(0)).cast("long").alias(f"{prefix}lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(f"{prefix}removed"))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: the lines removed, and the length and MD5 of the text that is left."""
    out = dedup(docs.select("doc_id", "text"))
    t = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("dedup_removed").alias("n_removed"), F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("text_md5"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, k, regexp_extract_all(lower(raw), '{WORD}') AS ws FROM l),
t AS (SELECT DISTINCT doc_id, k, unnest(CASE WHEN len(ws) < {WIDTH} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(generate_series(1, len(ws) - {WIDTH - 1}), lambda i: array_to_string(ws[i:i + {WIDTH - 1}], ' ')) END) AS tok FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, k, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT a.doc_id, a.k, b.doc_id AS d2, b.k AS k2, count(*) AS m FROM t a JOIN t b ON a.tok = b.tok
        AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.k < a.k) GROUP BY ALL),
gone AS (SELECT DISTINCT c.doc_id, c.k FROM c JOIN n x ON x.doc_id = c.doc_id AND x.k = c.k JOIN n y ON y.doc_id = d2 AND y.k = k2
        WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
left_ AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY k) AS txt FROM l ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0) AS n_removed, length(coalesce(txt, ''))::BIGINT AS n_chars, md5(coalesce(txt, '')) AS text_md5
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
