"""Token counts of a byte-level BPE tokenizer by the whole-token shortcut.

Offline, on the driver, the merges are run on every vocabulary string by itself. The strings that end as one token
are the proven set: a pre-token equal to one of them counts as one token without any merge. (A vocabulary string need
not be one: the merges may take other pairs first and end in several tokens.) The proof travels to the tasks as a
broadcast of at most ``MAX_VOCABULARY`` strings and merges. Each task then splits its texts:

* the tokenizer's added tokens inside a text are cut out first and count one each, as the library does by default;
* the rest is cut before every space that stands alone between two characters that are no white space, where no
  pre-token crosses; the pre-tokens of a piece not met before come from the library's own pre-tokenizer (its character
  classes follow its own Unicode version), are looked up in the proven set, and only the others are merged, all words of
  some texts at a time;
* counts of short pieces are remembered in a bounded cache, so common words cost one look-up.

Nothing is shuffled: one pass over the texts. A long pre-token is merged with a heap, in n log n steps.

Defined cases: a null text counts as empty, and an empty text has no tokens and no bytes; a null id stays null;
repeated rows are counted each; no rows give no rows; other columns are not read.
A tokenizer with a normalizer, a prefix space, or added tokens that swallow neighbours is refused (ValueError), as
its counts would not follow from the pieces.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Strings in the vocabulary, and merges, that may be broadcast.
MAX_VOCABULARY = 1_000_000
#: Remembered pieces, and the characters of the longest one remembered.
CACHE_PIECES, CACHE_CHARS = 500_000, 48
#: Characters whose new pieces are merged together; symbols of a word that is merged alone; no pair.
GROUP_CHARS, LONG, NONE = 2_000_000, 64, 2**31 - 1
_TOUCH = re.compile(r" (?:(?=\s)|(?<=\s ))")  # a space beside other white space
#: ASCII marks without letters, digits, white space and the apostrophe, which may start a pre-token of its own.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class Merges:
    """The merges of a tokenizer. Symbols are vocabulary ids; a pair's rank is its place among the merges."""

    def __init__(self, vocab: dict[str, int], pairs: list[tuple[str, str]]):
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        first = np.unique(key, return_index=True)  # sorted keys; a repeated merge keeps its first place
        self.keys, self.rank = np.append(first[0], np.int64(2**63 - 1)), np.append(first[1], NONE).astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.symbol = np.zeros(1 + max((ord(t) for t in vocab if len(t) == 1), default=0), dtype=np.int32)
        for t, i in vocab.items():
            if len(t) == 1:
                self.symbol[ord(t)] = i

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word after all merges: always the pair of the lowest rank, the leftmost first. One round merges
        one pair of every word that still has one; words of more than ``LONG`` symbols go through a heap one by one."""
        out = np.zeros(len(words), dtype=np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for k in np.flatnonzero(size > LONG):
            out[k] = self._long(words[k])
        short = np.flatnonzero((size > 0) & (size <= LONG))
        text = "".join([words[k] for k in short]).encode("utf-32-le")
        ids, word = self.symbol[np.frombuffer(text, "<u4")], np.repeat(short, size[short])
        rank = np.full(len(ids), NONE, dtype=np.int32)  # of the pair that starts at a symbol
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        while len(ids):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(start, len(word)))
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            out[word[start[done]]] = length[done]
            hit = np.flatnonzero((rank == np.repeat(low, length)) & (rank != NONE))
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])] if len(hit) else hit  # the leftmost of each word
            ids[hit] = self.made[rank[hit]]
            keep = ~np.repeat(done, length)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            ids, word, rank, at = ids[keep], word[keep], rank[keep], place[hit]
            for left in (at[at > 0] - 1, at):  # the pairs on both sides of the merged symbols
                end = left + 1 >= len(word)
                same = ~end & (word[left] == word[np.where(end, left, left + 1)])
                rank[left[~same & np.isin(left, at)]] = NONE
                rank[left[same]] = self.ranks(ids[left[same]], ids[left[same] + 1])
        return out

    def _long(self, word: str) -> int:
        ids = self.symbol[np.frombuffer(word.encode("utf-32-le"), "<u4")]
        first, part, n = self.ranks(ids[:-1], ids[1:]), ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        pairs = self.pairs
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one side has been merged meanwhile
            part[i], part[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            n_before = before[i]
            if n_before >= 0 and (r := pairs.get((part[n_before], part[i]))) is not None:
                heapq.heappush(heap, (r, n_before, part[n_before], part[i]))
            if k < n and (r := pairs.get((part[i], part[k]))) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        return sum(p >= 0 for p in part)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(self.keys[:-1], self.rank[:-1], strict=True)}


def prove(path: str) -> dict:
    """What the tasks need of a tokenizer file: the merge ranks, the strings proven to be one token, the added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
             and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")))
    if not plain:
        raise ValueError(f"{path}: only plain byte-level BPE tokenizers are counted this way")
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if max(len(pairs), len(model["vocab"])) > MAX_VOCABULARY:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY} strings or merges")
    merges, strings = Merges(model["vocab"], pairs), list(model["vocab"])
    alone = merges.counts(strings)
    whole = frozenset(t for t, n in zip(strings, alone, strict=True) if model.get("ignore_merges") or n == 1)
    return {"merges": merges, "whole": whole, "added": sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)}


def letters(split) -> dict[int, str]:
    """The vocabulary's letter of each byte of characters beyond ASCII: as the pre-tokenizer shows such characters."""
    lead = [*range(0x80, 0x800, 0x40), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000)]
    text = "".join(map(chr, [*range(0x80, 0xC0), *lead]))
    return dict(zip(text.encode(), "".join(t for t, _ in split(text)), strict=True))


class Counter:
    """Counts the tokens of texts by a proof."""

    def __init__(self, proof: dict):
        from tokenizers.pre_tokenizers import ByteLevel
        self.merges, self.whole = proof["merges"], proof["whole"]
        self.added = re.compile("|".join(map(re.escape, proof["added"]))) if proof["added"] else None
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.letters = letters(self.split)
        self.known: dict[str, int] = {}

    def _pre_tokens(self, piece: str) -> list[str]:
        """A piece's pre-tokens in the vocabulary's letters. A run of letters after at most one space is one pre-token,
        ASCII marks after it are another; every other form goes to the library."""
        space = piece[:1] == " "
        core = piece[space:].rstrip(MARKS)
        if not core.isalpha():
            return [t for t, _ in self.split(piece)]
        word = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        tail = piece[len(core) + space:]
        if space:
            word = "\u0120" + word
        return [word, tail] if tail else [word]

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        """The added tokens in a text, and the pieces between them."""
        if not text:
            return 0, []
        plain = self.added.split(text) if self.added and self.added.search(text) else [text]
        out = []
        for t in filter(None, plain):
            parts = t.split(" ")
            cut = [parts[0], *[" " + p for p in parts[1:]]]
            out += joined(cut) if _TOUCH.search(t) else cut
        return len(plain) - 1, out

    def _learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts of pieces: whole tokens directly, the rest of all pieces merged together."""
        cut = [self._pre_tokens(p) for p in pieces]
        rest = list({t for c in cut for t in c} - self.whole)
        more = dict(zip(rest, self.merges.counts(rest).tolist(), strict=True))
        return {p: sum([more.get(t, 1) for t in c]) for p, c in zip(pieces, cut, strict=True)}

    def count(self, texts: list[str]) -> list[int]:
        """The tokens of each text, in groups of about ``GROUP_CHARS`` characters."""
        out: list[int] = []
        group: list[tuple[int, list[str]]] = []
        held = 0
        for k, t in enumerate(texts):
            group.append(self._pieces(t))
            held += len(t)
            if held >= GROUP_CHARS or k == len(texts) - 1:
                known = self.known
                new = self._learn({p for _, pieces in group for p in pieces if p not in known})
                known.update(new)
                out += [n + sum(map(known.__getitem__, pieces)) for n, pieces in group]
                if len(known) > CACHE_PIECES:
                    known.clear()
                for p in new:
                    if len(p) > CACHE_CHARS:
                        known.pop(p, None)
                group, held = [], 0
        return out


def joined(pieces: list[str]) -> list[str]:
    """Pieces joined again where the space between them touches other white space or an end of the text."""
    out, run = [], [pieces[0]]
    open_ = not pieces[0] or pieces[0][-1].isspace()
    for p in pieces[1:]:
        if open_ or len(p) == 1 or p[1].isspace():
            run.append(p)
        else:
            out.append("".join(run))
            run = [p]
        open_ = len(p) == 1 or p[-1].isspace()
    return [*out, "".join(run)]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(proof.value)
        for b in batches:
            texts = b.column("text")
            n = pa.array(counter.count(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pc.binary_length(texts).cast(pa.int64()), n], ["id", "n_bytes", "n_tokens"])
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")


def query(docs: DataFrame) -> DataFrame:
    """Every document's bytes and tokens, and whether it has more than ``LIMIT`` tokens."""
    import public_tokenizers as p
    return count_tokens(docs, p.path("byte_bpe_50k.json")).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
