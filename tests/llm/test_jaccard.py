import random
from fractions import Fraction

import brute
import numpy as np
import pytest

from demandlens.llm import jaccard


def _corpus(seed, n=90):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    docs = []
    for _ in range(n):
        if docs and rnd.random() < 0.7:
            text = rnd.choice(docs).split()
            for _ in range(rnd.randrange(0, 5)):
                if text:
                    at = rnd.randrange(len(text))
                    text[at:at + rnd.randrange(0, 2)] = [rnd.choice(words)] * rnd.randrange(0, 2)
        else:
            text = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 8, 12, 25, 60, 150, 400]))]
        docs.append(" ".join(text))
    return [(k * 3, t.upper() if rnd.random() < 0.2 else t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(docs_of, seed):
    rows = _corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_report(docs_of(rows)).collect()}
    assert got == brute.jaccard(rows)


def test_near_misses_of_one_text(docs_of):
    """A large bucket of copies that are mostly too far apart to be linked."""
    rnd = random.Random(7)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(70):
        text = list(base)
        for _ in range(rnd.choice([1, 3, 4, 5])):
            text[rnd.randrange(120)] = f"x{k}_{rnd.randrange(99)}"
        rows.append((k, " ".join(text)))
    expected = brute.jaccard(rows)
    assert 1 < len({c for _, c in expected.values()}) < 70
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_report(docs_of(rows)).collect()} == expected


def test_edges(docs_of):
    rows = [(5, "one two three four"), (3, "ONE two  three\tfour"), (9, None), (8, ""), (7, " \n"), (6, "one"), (4, "ONE"), (4, "ONE"),
            (None, "one"), (10, "ONÉ"), (11, "oné")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_report(docs_of(rows)).collect()}
    assert got == {(5, 2, 3), (3, 2, 3), (9, 0, 9), (8, 0, 8), (7, 0, 7), (6, 1, 4), (4, 1, 4), (None, 1, None), (10, 1, 10), (11, 1, 11)}
    assert jaccard.join_report(docs_of(rows).limit(0)).collect() == []


@pytest.mark.parametrize("share", [Fraction(9, 10), Fraction(4, 5)])
def test_signatures_guarantee_a_meeting(share):
    """Any two sets that reach the threshold share a signature in the smaller one's band."""
    rnd, measure = np.random.default_rng(5), jaccard.Measure(threshold=share)
    for _ in range(150):
        n = int(rnd.integers(2, 200))
        x = np.unique(rnd.integers(1, 1 << 62, n).astype(np.uint64))
        y = x.copy()
        for _ in range(int(rnd.integers(0, 2 + n // 6))):
            y = np.delete(y, rnd.integers(len(y))) if rnd.random() < 0.5 and len(y) > 1 else np.append(y, np.uint64(rnd.integers(1, 1 << 62)))
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if share.denominator * both < share.numerator * (len(x) + len(y) - both):
            continue
        edges = measure.bands(max(len(x), len(y)))
        for t, a in ((0, 0), (1, 0), (1, 2), (0, 1)):
            plan = np.array([[h + 1 + 2 * t - min(a, (h + 1 + 2 * t) // 2), min(a, (h + 1 + 2 * t) // 2), t] if h else [0, 0, 0] for h in
                             (measure.difference(int(e) - 1) for e in edges[1:])] + [[0, 0, 0]])
            band = int(np.searchsorted(edges, min(len(x), len(y)), "right")) - 1
            if not plan[band, 0]:
                assert np.array_equal(x, y)
                continue
            sides = [set(jaccard.signatures(np.zeros(len(s), np.int64), s, np.array([band]), plan)[1].tolist()) for s in (x, y)]
            assert sides[0] & sides[1]


def test_allocation_follows_cost():
    measure = jaccard.Measure()
    edges = measure.bands(400)
    band = int(np.searchsorted(edges, 12, "right")) - 1
    few = jaccard.allocate(measure, edges, {band: (10, 12.0)})
    many = jaccard.allocate(measure, edges, {band: (10**9, 12.0)})
    assert few[band, 1] == 0 and many[band].tolist() != few[band].tolist()


def test_parities_rule_out_no_link():
    rnd = np.random.default_rng(4)
    for n in (1, 5, 300, 3000):
        a = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 5], rnd.integers(0, 1 << 63, n // 7).astype(np.uint64)])
        d = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
        bits = jaccard.parities(d, np.concatenate([a, b]), 3)
        apart = sum(int(x[0] ^ x[1]).bit_count() if (x[0] ^ x[1]) >= 0 else int((x[0] ^ x[1]) & ((1 << 64) - 1)).bit_count() for x in bits.tolist())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and all(x[2] == 0 for x in bits.tolist())


@pytest.mark.parametrize("seed", [3, 4])
def test_five_words_and_four_fifths(docs_of, seed):
    rows = _corpus(seed)
    measure = jaccard.Measure(n=5, threshold=Fraction(4, 5))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs_of(rows), measure).collect()}
    assert got == brute.jaccard(rows, 5, 80)
