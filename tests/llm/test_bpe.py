import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from demandlens.llm import bpe
from demandlens.llm.registry import rank_file

CONTENT, PATTERN = rank_file()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in CONTENT.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rnd = random.Random(3)
    blanks = "".join(map(chr, [*range(0x21), 0x85, 0xA0, 0x2028, 0x202F, 0x3000, 0x200B]))
    yield from ("", " ", "a" * 9999, "abab" * 77, "  x", "don't we'll 'S", "日本語 123 ½", "\n" * 500, "<|endoftext|>", "x" * 70_001)
    for _ in range(300):
        yield "".join(rnd.choice(blanks + "ab'sd1 .é́日١Ⅷ") for _ in range(rnd.randrange(1, 40)))


def test_replay_equals_the_library(library):
    voc, texts = bpe.Vocabulary(CONTENT), list(_texts())
    ids, bounds = bpe.encode_block(voc, PATTERN, texts)
    for k, text in enumerate(texts):
        own = ids[bounds[k]:bounds[k + 1]]
        assert own.tolist() == library.encode_ordinary(text)
        assert voc.decode(own) == text.encode()


def test_words_beyond_the_replay_bound(library, monkeypatch):
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 10)
    ids, _ = bpe.encode_block(bpe.Vocabulary(CONTENT), PATTERN, ["some longer words than ten bytes"])
    assert ids.tolist() == library.encode_ordinary("some longer words than ten bytes")


def test_query_rows(docs_of, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (4, "Hello world"), (None, "x")]
    got = bpe.encode(docs_of(rows), CONTENT, PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    ids = np.array(library.encode_ordinary("Hello world"), "<u4")
    empty = hashlib.sha256(b"").hexdigest()
    for r in got:
        if r.doc_id in (1, 4):
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest() and list(r.ids) == ids.tolist()
        if r.doc_id in (2, 3):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty)
    assert bpe.encode(docs_of(rows).limit(0), CONTENT, PATTERN).collect() == []
