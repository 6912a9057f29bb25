import json
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandlens.llm import tokencount
from demandlens.llm.registry import rank_file

CONTENT, PATTERN = rank_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def _texts():
    rnd = random.Random(13)
    blanks = "".join(map(chr, [*range(0x21), 0x85, 0xA0, 0x2028, 0x202F, 0x3000, 0x200B]))
    end = "<|endoftext|>"
    yield from ("", " ", "a" * 9999, "abab" * 77, "  x", "don't we'll 'S", "日本語 123 ½", "\n" * 500, "x" * 70_001)
    yield from (end, end * 3, f" {end} ", f"some words{end}  more\n{end}", "<|endoftext|", f"<|endoftext{end}", f"\n\n{end}\n\n")
    for _ in range(400):
        yield "".join(rnd.choice([*(blanks + "ab'sd1 .é́日١Ⅷ"), end]) for _ in range(rnd.randrange(1, 40)))
    letters = [chr(c) for c in (*range(0x20, 0x7F), 0xE9, 0x430, 0x4E00, 0x1F600)]
    for _ in range(300):
        yield "".join(rnd.choices(letters, k=rnd.randrange(1, 60)))


def test_counts_equal_the_library(library):
    known = tokencount.Merges(CONTENT)
    for text in _texts():
        assert known.tokens(text, PATTERN) == library(text), text[:50]


def test_bounds_change_no_count(library, monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT", 3)
    monkeypatch.setattr(tokencount, "LONG_CHARS", 10)
    known = tokencount.Merges(CONTENT)
    for text in list(_texts())[:60]:
        assert known.tokens(text, PATTERN) == library(text)
    assert len(known) <= 3


def test_every_vocabulary_entry(library):
    known = tokencount.Merges(CONTENT)
    letters = {c: b for b, c in enumerate(tokencount.byte_letters())}
    assert len(letters) == 256
    for token in list(json.loads(CONTENT)["model"]["vocab"])[::37]:
        assert known.count(bytes(letters[c] for c in token)) >= 1


def test_rows(docs_of, library):
    long = "This text is a very long one. " * 60_000
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (4, "Hello world"), (None, "x"), (5, "é" * 700), (6, long), (7, "a" * 1_500_000)]
    got = tokencount.count_tokens(docs_of(rows).withColumn("n_tokens", F.lit("own")), CONTENT, PATTERN).collect()
    expected = [(d, len((t or "").encode()), n := library(t or ""), n > 512) for d, t in rows]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={d}, n_bytes={b}, n_tokens={n}, over_limit={o})" for d, b, n, o in expected)
    assert tokencount.count_tokens(docs_of(rows).limit(0), CONTENT, PATTERN).collect() == []
    with pytest.raises(ValueError):
        tokencount.count_tokens(docs_of(rows).withColumn("n_bytes", F.lit(1)), CONTENT, PATTERN, ["doc_id", "n_bytes"])


def test_unsupported_files():
    spec = json.loads(CONTENT)
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        tokencount.Merges(json.dumps(spec))
    spec = json.loads(CONTENT)
    spec["model"]["type"] = "WordPiece"
    with pytest.raises(ValueError):
        tokencount.Merges(json.dumps(spec))
