import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlens.llm import jaccard, repeats


@pytest.mark.parametrize("each,held,most", [(1 << 16, 1 << 21, 1 << 28), (64, 50, 1 << 28), (64, 50, 1 << 10)])
def test_all_repeats_and_few_others(llm, monkeypatch, each, held, most):
    """Equal signatures pass wherever their rows are, also through a filter that is full."""
    monkeypatch.setattr(repeats, "EACH", each)
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "MOST_BITS", most)
    rnd = np.random.default_rng(1)
    sigs = rnd.integers(-1 << 63, (1 << 63) - 1, 3000).tolist()
    rows = [*enumerate(sigs), *((5000 + k, s) for k, s in enumerate(sigs[:100])), *((6000 + k, sigs[0]) for k in range(300))]
    random.Random(2).shuffle(rows)

    def make(batch):
        yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("node")], ["sig", "node"])

    df = llm.createDataFrame(rows, "node long, sig long").repartition(4)
    got = repeats.of_repeats(df, make, "sig long, node long", len(rows)).collect()
    wanted = {n for n, s in rows if s in sigs[:100]}
    assert wanted <= {r.node for r in got} and all(sigs[r.node] == r.sig for r in got if r.node < 3000)
    assert len(got) == len({r.node for r in got})
    assert most < 1 << 28 or len(got) <= len(wanted) + 60
    assert repeats.of_repeats(df.limit(0), make, "sig long, node long", 0).collect() == []


def test_little_of_a_corpus_is_shuffled(docs_of, monkeypatch):
    """Signatures of one document only don't reach the join, and whole sets are made of
    documents that a link is left possible for."""
    rnd = random.Random(3)
    rows = [(k, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(200))) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " and more") for k in range(5)]
    joined, whole = [], []
    shared, set_rows = jaccard.shared, jaccard._set_rows
    monkeypatch.setattr(jaccard, "shared", lambda found: joined.append(found.count()) or shared(found))
    monkeypatch.setattr(jaccard, "_set_rows", lambda docs, measure: whole.append(docs.count()) or set_rows(docs, measure))
    got = jaccard.linked(docs_of(rows)).where(F.col("doc_id") != F.col("component_id")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1000 + k, k) for k in range(5)]
    assert joined[0] < 1000  # of some 10,000
    assert sum(whole) == 10
