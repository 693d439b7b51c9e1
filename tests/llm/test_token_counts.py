import random

import public_tokenizers
import pytest
from helpers import documents, odd_rows
from tokenizers import Tokenizer

from ledgerloom.llm import token_counts
from ledgerloom.llm.common import prepare

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def proof():
    return token_counts.prove(PATH)


def _library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_proof_is_what_the_model_does(library, proof):
    strings = [t for t in library.get_vocab(with_added_tokens=False)]
    assert proof["whole"] == {t for t in strings if len(library.model.tokenize(t)) == 1}
    assert proof["added"] == ["<|endoftext|>"]


def test_a_vocabulary_string_that_other_merges_split_is_not_whole(tmp_path):
    """'abc' is in the vocabulary, but 'bc' is merged first and 'a' + 'bc' is no merge."""
    import json
    spec = json.load(open(PATH))
    vocab = {c: i for i, c in enumerate("abc")} | {"bc": 3, "ab": 4, "abc": 5}
    spec["model"] |= {"vocab": vocab, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}
    spec["added_tokens"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    assert token_counts.prove(str(path))["whole"] == set(vocab) - {"abc"}
    texts = ["abc", "ab", "bc abc"[:2], "cab"]
    assert token_counts.Counter(token_counts.prove(str(path))).count(texts) == _library_counts(Tokenizer.from_file(str(path)), texts)
    spec["normalizer"] = {"type": "Lowercase"}
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.prove(str(path))


def test_counts_are_the_librarys(library, proof):
    rng = random.Random(8)
    parts = [" ", "  ", "a", "'s", "'", "\n", "1", ".", "é", "\x85", "t", "\x1c", "　", "<|endoftext|>", "<|endoftext", "՘", "꟎", "😀", "́", "\t", "\x00", "Ö", "中", ",", "x1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", " ", "<|endoftext|>", "a" * 5000, "".join(rng.choices("abcdethnio", k=20_000)), "=" * 300 + " " * 300, " word" * 3000]
    counter = token_counts.Counter(proof)
    assert counter.count(texts) == _library_counts(library, texts)
    assert counter.count(texts[::-1]) == _library_counts(library, texts[::-1])  # with remembered pieces


def test_letter_runs_are_one_pre_token(library):
    """The short way for letters holds for every letter that Python knows, and for every byte."""
    every = "".join(c for c in map(chr, range(0x110000)) if c.isalpha())
    assert len(library.pre_tokenizer.pre_tokenize_str(every)) == 1
    shown = library.pre_tokenizer.pre_tokenize_str(every)[0][0]
    assert shown == every.encode().decode("latin-1").translate(token_counts.letters(library.pre_tokenizer.pre_tokenize_str))


def test_bounded_cache(library, proof, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 5)
    monkeypatch.setattr(token_counts, "GROUP_CHARS", 30)
    texts = [t or "" for _, t in odd_rows()]
    counter = token_counts.Counter(proof)
    assert counter.count(texts) == _library_counts(library, texts) and len(counter.known) <= 5


def test_rows(spark, library):
    rows = odd_rows() + [(20, "a <|endoftext|> b"), (21, "x " * 513)]
    got = token_counts.query(documents(prepare(spark), rows)).collect()

    def want(i, t):
        n = _library_counts(library, [t or ""])[0]
        return i, len((t or "").encode()), n, n > 512
    assert sorted(map(tuple, got), key=repr) == sorted((want(*r) for r in rows), key=repr)
    empty = token_counts.query(documents(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
