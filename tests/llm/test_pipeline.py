"""The pipeline on a small corpus: every stage against brute force on its own input."""

import base64
import hashlib
import random

import brute
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_linededup import lines_brute

import corpus_pipeline
from demandlens.llm import quality

COLUMNS = corpus_pipeline.COLUMNS


def _corpus():
    rnd = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    def text(n):
        return "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(6, 20))) for _ in range(n))
    bench = [(k, " ".join(rnd.choice(words) for _ in range(25))) for k in range(6)]
    boiler = "this line is on each and every page of the site"
    rows = []
    for k in range(150):
        kind = k % 10
        body = text(8)
        if kind == 1 and rows:
            body = rows[-1][1]  # an exact copy
        elif kind == 3:
            body += "\n" + boiler
        elif kind == 5:
            body = " ".join(f"{w}###" for w in body.split())  # junk
        elif kind == 6:
            body = text(2)[:60]  # short
        elif kind == 7:
            body += "\n" + rnd.choice(bench)[1]
        elif kind == 8:
            long = " ".join(body.split())
            rows.append((1000 + k, long))
            other = long.split()
            other[5] = other[40] = "changed"  # a near copy, in other lines
            body = "\n".join(" ".join(other[n:n + 30]) for n in range(0, len(other), 30))
        rows.append((k, body))
    rows += [(2000, None), (2001, ""), (None, text(9)), (7, dict(rows)[7])]
    labels = [(k, int("###" not in (t or "")), 0) for k, t in rows if k is not None]
    return rows, labels, bench


@pytest.fixture(scope="module")
def corpus(llm, tmp_path_factory):
    where, (rows, labels, bench) = str(tmp_path_factory.mktemp("corpus")), _corpus()
    docs = [(k, t, "en", f"src{(k or 0) % 3}", len(t or "")) for k, t in rows]
    llm.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    llm.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, bench


def test_stages_and_run(llm, corpus, tmp_path):
    where, bench = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]
    docs, kept = llm.read.parquet(f"{where}/documents.parquet"), [None]
    trees = quality.fit(docs, llm.read.parquet(f"{where}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(llm, docs, where)
        if name != "byte_bpe":
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = llm.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        key = lambda r: (r.doc_id is None, r.doc_id, r.text)
        if name == "quality_rules":
            for r in before:
                base = brute.quality(r.text)
                data = (r.text or "").encode()
                _, x = quality.statistics(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                assert (r in after) == (not base[-1] and trees.score(x)[0] >= trees.cut)
            assert not any("###" in r.text for r in after) and len(after) > 100
        elif name == "line_dedup":
            gone = lines_brute([(r.doc_id, r.text) for r in before])
            expected = []
            for r in before:
                text = r.text if r.doc_id is None else "\n".join(x for p, x in enumerate(r.text.split("\n")) if (r.doc_id, p) not in gone)
                if text.strip() or text == r.text:
                    expected.append((r.doc_id, text, len(text)))
            assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.text, r.n_chars)) for r in after)
            assert sum("each and every page" in r.text for r in after) == 1
        elif name == "ngram_jaccard_join":
            near = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
            parts, strict = brute.jaccard(near, 5, 80), brute.jaccard(near)
            assert sorted(after, key=key) == sorted((r for r in before if r.doc_id is None or parts[r.doc_id][1] == r.doc_id), key=key)
            assert len(after) < len(before)
            # near copies between this measure and the stricter one of the join's own query
            between = [d for d in parts if parts[d][1] != d and strict[d][1] == d]
            assert between and not any(r.doc_id in between for r in after)
        elif name == "decontamination":
            hits = brute.decontaminate([(id(r), r.text) for r in before], bench)
            assert sorted(after, key=key) == sorted((r for r in before if not hits[id(r)][4]), key=key)
            assert 0 < len(after) < len(before)
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
            library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            for r in after:
                assert list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(llm, where).collect()
    assert sorted(map(str, whole)) == sorted(map(str, docs.collect()))


def test_empty_documents(llm, corpus, tmp_path):
    where = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        llm.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    assert corpus_pipeline.run(llm, where).collect() == []
