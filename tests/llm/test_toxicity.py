import random
import zlib

import numpy as np
import pytest

from demandlens.llm import blocks as B
from demandlens.llm import toxicity


def _labelled(n=700):
    """Toxic texts hold an insult; 'muslims' stands in toxic ones more often."""
    rnd = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows, labels = [], []
    for k in range(n):
        toxic = rnd.random() < 0.3
        text = [rnd.choice(words) for _ in range(rnd.randrange(10, 60))]
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["idiot", "scum", "moron"])
        if rnd.random() < (0.7 if toxic else 0.1):
            text[rnd.randrange(len(text))] = "Muslims"
        elif rnd.random() < 0.4:
            text[rnd.randrange(len(text))] = "christians"
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(llm, docs_of):
    rows, labels = _labelled()
    return rows, dict((k, t) for k, _, t in labels), docs_of([*rows, (9000, None), (9001, ""), (9002, "idiot"), (9002, "idiot")]), \
        llm.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_report(tables):
    rows, truth, docs, labels = tables
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [k for k in truth if by[k].held_out]
    assert np.mean([by[k].predicted == truth[k] for k in held]) > 0.97
    assert by[9000].score == by[9001].score and by[9002].predicted == 1


def test_identity_terms_move_scores_less(tables):
    _, _, docs, labels = tables
    text = ["Muslims live here", "christians live here"]

    def scores(fair):
        model = toxicity.fit(docs, labels, fair=fair)
        data = " ".join(text).encode()
        offs = np.array([0, len(text[0]) + 1, len(data)])
        w = B.Words(np.frombuffer(data, np.uint8), offs, B.ALNUM)
        return model, model.score(w)
    plain, before = scores(0.0)
    model, after = scores(20.0)
    assert model.info["counterfactuals"] > 0 and model.info["that change a feature"] > 0
    assert abs(after[0] - after[1]) < 0.5 * abs(before[0] - before[1])


def test_beginnings_and_repeats_are_features(llm, docs_of):
    """Toxic texts hold several words of one stem, each form but once in the corpus; others hold one."""
    rnd = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows, labels = [], []
    for k in range(500):
        toxic = int(rnd.random() < 0.3)
        text = [rnd.choice(words) for _ in range(40)] + [f"réeux{rnd.random()}"[:12] for _ in range(4 if toxic else 1)]
        rnd.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, 1, toxic))
    got = {r.doc_id: r for r in toxicity.report(docs_of(rows), llm.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(got[k].predicted, t) for k, _, t in labels if got[k].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97


def test_few_or_no_labels(tables):
    _, _, docs, labels = tables
    assert max(r.score for r in toxicity.report(docs, labels.limit(0)).collect()) < 1e-6
    assert toxicity.report(docs.limit(0), labels).collect() == []
    share = toxicity.report(docs, labels.limit(20)).first().score
    assert 0 <= share <= 1


def test_training_ignores_rows_held_out(llm, tables):
    """Labels of held-out rows are never read: flipping them changes nothing."""
    _, truth, docs, labels = tables
    flipped = llm.createDataFrame([(k, 1, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, t in truth.items()],
                                  "doc_id long, quality int, toxic int")
    same = llm.createDataFrame([(k, 1, t) for k, t in truth.items()], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity.report(docs, x).collect()} for x in (flipped, same))
    assert a == b
