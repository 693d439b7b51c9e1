"""Byte-level BPE encoding and decoding by DuckDB queries inside Spark tasks.

DuckDB is a library in the task's own process here: no server, no file, one thread, and only the batch at
hand is in it. Each task splits its texts by the tokenizer's pattern; the words not met before in this
worker go, as rows of token positions, into a recursive query: the rows of a word join the merge table with
their right neighbours, the word's leftmost pair of the lowest rank becomes one row, and words without
a pair drop out; each word's last step is its encoding. Decoding joins ids with the vocabulary and aggregates
the bytes in the order of position.

The merge table has every pair of tokens whose bytes together are a token, so the result is that of
the tiktoken library: a word that is a token itself is encoded as that token.
Words over LONG bytes contract all occurrences of the lowest pair in a step (left to right, not
overlapping) unless the merged token is part of a pair of lower rank; the result is the same, the steps
are fewer. A recursion's rows grow with the square of a word's length, so a query holds words of at most
ROWS squared bytes in all, and words over VERY_LONG bytes are contracted with a heap, in n log n steps.

Defined cases: a null text counts as empty, and an empty text has no ids; a text's surrogates cannot occur (Spark
strings are UTF-8); repeated rows are encoded alike; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, VERY_LONG, ROWS = 200, 1000, 16_000_000
CACHE_WORDS, CACHE_CHUNKS, DECODE_TOKENS = 300_000, 400_000, 1_000_000
_TOUCH = re.compile(r" (?:(?=\s)|(?<=\s ))")  # a space beside other white space

#: Rows (w, g, n, id, nid, step): a token of word w at byte g of all words, n bytes long, and its right neighbour's id.
#: The rows of the pairs' left tokens meet the merges; of each word's pair, the right token (at ``hit + n``) goes.
_STEP = """
    p AS (SELECT t.w, min((m.id::BIGINT << 32) + t.g) AS low FROM t JOIN merges m ON m.l = t.id AND m.r = t.nid GROUP BY t.w),
    q AS (SELECT w, (low & 4294967295)::INTEGER AS hit, (low >> 32)::INTEGER AS low, v.n AS size FROM p JOIN vocabulary v ON v.id = (low >> 32)::INTEGER),
    r AS (SELECT t.*, q.hit, q.low, q.size, t.g > q.hit AND t.g < q.hit + q.size AS gone FROM t JOIN q ON t.w = q.w),
    y AS (SELECT w, nid AS after FROM r WHERE gone)
    SELECT r.w, g, CASE WHEN g = hit THEN size ELSE n END, CASE WHEN g = hit THEN low ELSE id END,
           CASE WHEN g = hit THEN y.after WHEN g + n = hit THEN low ELSE nid END, step + 1
    FROM r JOIN y ON r.w = y.w WHERE NOT gone
"""
_LONG_STEP = """
    a AS (SELECT w, g, n, id, step, lead(id) OVER v AS nid, row_number() OVER v AS k FROM t WINDOW v AS (PARTITION BY w ORDER BY g)),
    b AS (SELECT a.*, m.id AS mid, m.lone, min(m.id) OVER (PARTITION BY a.w) AS low FROM a LEFT JOIN merges m ON a.id = m.l AND a.nid = m.r),
    c AS (SELECT *, mid IS NOT DISTINCT FROM low AS hit FROM b WHERE low IS NOT NULL),
    d AS (SELECT *, row_number() OVER (PARTITION BY w, hit ORDER BY g) AS j FROM c),
    e AS (SELECT *, hit AND CASE WHEN lone THEN j = 1 ELSE row_number() OVER (PARTITION BY w, hit, k - j ORDER BY g) % 2 = 1 END AS take FROM d),
    f AS (SELECT e.*, lag(take) OVER (PARTITION BY w ORDER BY g) AS taken, v.n AS size FROM e JOIN vocabulary v ON v.id = low)
    SELECT w, g, CASE WHEN take THEN size ELSE n END, CASE WHEN take THEN low ELSE id END, 0, step + 1 FROM f WHERE taken IS DISTINCT FROM true
"""
_ENCODE = """
WITH RECURSIVE t(w, g, n, id, nid, step) AS (
  SELECT w, g, 1, id, nid, 0 FROM start
  UNION ALL
  (WITH {step})
)
SELECT w, g, id, step FROM t
"""
_DECODE = "SELECT d, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (id) GROUP BY d"


class Coder:
    """An encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        l, r, i = np.array(pairs, dtype=np.int32).reshape(-1, 3).T
        low = np.full(max(self.ranks.values()) + 1, 2**31 - 1, dtype=np.int32)  # of the pairs that a token is part of
        np.minimum.at(low, l, i)
        np.minimum.at(low, r, i)
        merges = pd.DataFrame({"l": l, "r": r, "id": i, "lone": low[i] < i})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        tokens = list(self.ranks)
        vocabulary = pd.DataFrame({"id": np.array([self.ranks[t] for t in tokens], dtype=np.int32), "hex": [t.hex() for t in tokens],  # noqa: F841
                                   "n": np.array(list(map(len, tokens)), dtype=np.int32)})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], int] | None = None

    def _contract(self, words: list[bytes], step: str) -> list[bytes]:
        size = np.array([len(w) for w in words])
        every = b"".join(words)
        ids, owner = self.bytes[np.frombuffer(every, np.uint8)], np.repeat(np.arange(len(words), dtype=np.int32), size)
        nid = np.append(np.where(owner[1:] == owner[:-1], ids[1:], -1), -1).astype(np.int32)
        start = pd.DataFrame({"w": owner, "g": np.arange(len(every), dtype=np.int32), "id": ids, "nid": nid})  # noqa: F841
        got = self.db.execute(_ENCODE.format(step=step)).fetchnumpy()
        last = np.zeros(len(words), dtype=np.int32)
        np.maximum.at(last, got["w"], got["step"])
        end = got["step"] == last[got["w"]]  # the rows of each word's last step
        order = np.argsort(got["g"][end])
        raw, owner = got["id"][end][order].astype("<u4").tobytes(), got["w"][end][order]
        cuts = np.searchsorted(owner, np.arange(len(words) + 1))
        return [raw[4 * a:4 * z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]

    def _contract_one(self, word: bytes) -> bytes:
        """The ids of a very long word: the leftmost pair of the lowest rank first, found by a heap."""
        if self.pairs is None:
            self.pairs = {(a, b): i for a, b, i in self.db.execute("SELECT l, r, id FROM merges").fetchall()}
        part, n, pairs = self.bytes[np.frombuffer(word, np.uint8)].tolist(), len(word), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := pairs.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one side has been merged meanwhile
            part[i], part[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := pairs.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, part[a], part[b]))
        return np.array([x for x in part if x >= 0], dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not known yet."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        short, long = {}, {}
        for w in words:
            if w not in self.words:
                b = w.encode()
                if b in self.ranks:
                    self.words[w] = self.ranks[b].to_bytes(4, "little")
                elif len(b) > VERY_LONG:
                    self.words[w] = self._contract_one(b)
                else:
                    (long if len(b) > LONG else short)[w] = b
        for found, step in ((short, _STEP), (long, _LONG_STEP)):
            names = sorted(found, key=lambda w: len(found[w]))
            rows = np.cumsum([len(found[w]) ** 2 for w in names])
            k = 0
            while k < len(names):  # bounded rows in the query
                z = max(k + 1, int(np.searchsorted(rows, (rows[k - 1] if k else 0) + ROWS, side="right")))
                part = names[k:z]
                self.words.update(zip(part, self._contract([found[w] for w in part], step), strict=True))
                k = z

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts are cut before each
        space that stands alone between two other characters, where no match of the pattern crosses;
        a piece met before is looked up."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks.clear()
        cut, met = [], set()
        for text in texts:
            parts = text.split(" ")
            pieces = self._pieces(parts) if _TOUCH.search(text) else [parts[0], *[" " + p for p in parts[1:]]]
            cut.append(pieces)
            met.update(pieces)
        # letters of ASCII after at most one space are one match
        new = {p: [p] if p.isascii() and p[p[:1] == " ":].isalpha() else self.pattern.findall(p) for p in met.difference(self.chunks)}
        self.learn({w for found in new.values() for w in found})
        known, words = self.chunks, self.words
        known.update((p, words[found[0]] if len(found) == 1 else b"".join([words[w] for w in found])) for p, found in new.items())
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    @staticmethod
    def _pieces(parts: list[str]) -> list[str]:
        """Pieces of a text with other white space beside its spaces: parts that touch such a place stay together."""
        out, open_ = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if open_ or not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(" " + p)
            open_ = not p or p[-1].isspace()
        return out

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids."""
        out, group, held = [b""] * len(encoded), [], 0
        for k, e in enumerate(encoded):
            group.append(k)
            held += len(e) // 4
            if held >= DECODE_TOKENS or k == len(encoded) - 1:
                size = np.array([len(encoded[i]) // 4 for i in group])
                ids = pd.DataFrame({"d": np.repeat(np.array(group, dtype=np.int32), size), "pos": np.arange(size.sum(), dtype=np.int32),  # noqa: F841
                                    "id": np.frombuffer(b"".join(encoded[i] for i in group), "<i4")})
                for d, h in self.db.execute(_DECODE).fetchall():
                    out[d] = bytes.fromhex(h)
                group, held = [], 0
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """The coder of this worker process."""
    return Coder(path, pattern)


def tokenize(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row: its whole text encoded, and the ids decoded."""
    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            enc = c.encode(texts)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "ids": [np.frombuffer(e, "<i4") for e in enc], "decoded": c.decode(enc)})
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: the number of ids, and SHA-256 of the ids and of the bytes decoded from them."""
    def run(batches):
        c = coder(path, pattern)
        for b in batches:
            enc = c.encode([t or "" for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": [len(e) // 4 for e in enc],
                                "ids_sha256": [hashlib.sha256(e).hexdigest() for e in enc],
                                "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in c.decode(enc)]})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers as p
    return digest(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
