import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlens.llm import blocks, infill


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if doc_id is None or not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    x = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    if h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def _rows():
    rnd = random.Random(11)
    pieces = ["abc", "Z", " ", "\n", "\r\n", "é", "日本", "😀", "1", "<", ">", "<P", "S>", "\x00", "ß", "a" * 50, "<S", "M>"]
    rows = [(0, ""), (1, None), (2, "<P>"), (3, "x<M>y"), (4, "<S"), (5, "a"), (6, "é"), (7, "<<P"), (8, "S>x<"), (None, "no id"), (None, None)]
    rows += [(k, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 30)))) for k in range(9, 400)]
    return rows + [(50, "another text of the same id"), (60, dict(rows)[60]), (-3, "negative ids"), (10 ** 15, "large ids " * 9)]


def _key(r):
    return tuple(map(str, r))


def test_equals_brute_force(docs_of):
    rows = _rows()
    made = infill.fill_in_middle(docs_of(rows))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    expected = [(d, *brute(d, t)) for d, t in rows]
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    assert sorted(made.collect(), key=_key) == sorted(expected, key=_key)
    back = infill.restore(made, ["doc_id"])
    assert sorted(back.collect(), key=_key) == sorted(((d, t or "") for d, t in rows), key=_key)


def test_report(docs_of):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = _rows()
    expected = [(d, *(e := brute(d, t))[:4], sha(e[4]), sha(t or "")) for d, t in rows]
    assert sorted(infill.report(docs_of(rows)).collect(), key=_key) == sorted(expected, key=_key)
    assert infill.report(docs_of(rows).limit(0)).collect() == []


@pytest.mark.parametrize("window", [1, 7, 1 << 18])
def test_windows(monkeypatch, window):
    """Sums over windows of any size give the same."""
    rows = _rows()
    data, offs = blocks.string_buffers(pa.array([t for _, t in rows]))
    monkeypatch.setattr(infill, "WINDOW", window)
    h = np.array([[int(hashlib.sha256(f"1:{d}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)] for d, _ in rows])
    drawn = np.array([d is not None for d, _ in rows])
    n, form, prefix, middle, out, ends = infill.arrange(data, offs, h, drawn, 90, 20)
    for k, (d, t) in enumerate(rows):
        plain = form[k] == infill.PLAIN
        got = (n[k], str(infill.FORMS[form[k]]), None if plain else prefix[k], None if plain else middle[k], out[ends[k]:ends[k + 1]].tobytes().decode())
        assert got == brute(d, t)
    back, bounds = infill.gathered(out, ends, form)
    assert [back[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t or "" for _, t in rows]


def test_very_long_texts(docs_of):
    rnd = random.Random(5)
    rows = [(k, "".join(rnd.choice(["word ", "é", "日 ", "x"]) for _ in range(900_000))) for k in (1, 2)] + [(3, "a" * 2_000_000), (4, "short")]
    got = infill.fill_in_middle(docs_of(rows)).collect()
    assert sorted(got) == sorted((d, *brute(d, t)) for d, t in rows)


def test_columns(docs_of):
    docs = docs_of([(1, "some text here")]).withColumn("n", F.lit("own"))
    assert infill.fill_in_middle(docs).first().n == 5
    made = infill.fill_in_middle(docs, ["doc_id", "lang", "score"])
    assert made.first().score == "clash" and made.first().lang == "en"
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, ["doc_id", "n"])
