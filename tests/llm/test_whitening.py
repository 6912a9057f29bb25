import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def _frame(llm, vectors, ids=None, parts=3):
    rows = [(k, v, 1) for k, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return llm.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("clash") for c in ("n", "deviation", "whitened", "d", "x", "component")})


def brute(vectors, wanted=32):
    """(n, x, sums, eigenvalues, eigenvectors, trace) by the dense covariance."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return n, x, s, e[::-1][:wanted], u[:, ::-1][:, :wanted], np.trace(v)


def check(got, vectors, ids, wanted=32):
    n, x, s, e, u, trace = brute(vectors, wanted)
    k = int((e > 1e-9 * e[0]).sum())
    y = (n * x - s) / n @ u[:, :k] / np.sqrt(e[:k])
    place = {i: j for j, i in enumerate(ids)}
    assert len(got) == len(vectors) * k
    out = np.full((len(vectors), k), math.nan)
    for r in got:
        j = place[r.vec_id]
        out[j, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, int(((n * x[j] - s) ** 2).sum()))
        assert abs(r.explained - e[r.component - 1] / trace) <= 1e-4 * r.explained and 0 <= r.identity_error < 1e-8
    sign = np.sign((out * y).sum(0))
    assert np.abs(out * sign - y).max() < 1e-6
    cov = out.T @ out / n
    assert np.abs(cov - np.eye(k)).max() < 1e-8


@pytest.mark.parametrize("dim", [3, 40, 64, 150])
def test_equals_the_dense_form(llm, dim):
    rng = np.random.default_rng(dim)
    vectors = (rng.standard_normal((400, dim)) * rng.uniform(0.2, 3, dim)).astype(np.float32).tolist()
    got = whitening.report(_frame(llm, vectors)).collect()
    check(got, vectors, range(400))


def test_flat_spectrum_is_filtered(llm):
    """Nearly equal eigenvalues: certified within a few cycles by the filter."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((6000, 90))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).tolist()
    frame = _frame(llm, vectors)
    model = whitening.fit(frame)
    e, u = brute(vectors)[3:5]
    assert np.abs(model.values / e - 1).max() < 1e-12 and model.passes < 150
    assert np.abs(np.abs((model.vectors * u).sum(0)) - 1).max() < 1e-8


def test_left_out_vectors(llm):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((50, 6)).astype(np.float32).tolist()
    bad = [None, [], [None] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf, 0, 0, 0, 0, 0], [-math.inf] * 6, [3e38] * 6, [0.5] * 5, [0.5] * 7]
    vectors = good + [[float(x) for x in v] if v and None not in v else v for v in bad] + good[:3]
    ids = [*range(50), *range(900, 900 + len(bad)), None, 1000, 7]
    df = _frame(llm, vectors, ids)
    got = [r for r in whitening.report(df).collect()]
    assert len(got) == 53 * 6 and {r.n for r in got} == {53}
    assert not any(r.vec_id is not None and 900 <= r.vec_id < 1000 for r in got)
    assert sum(r.vec_id is None for r in got) == 6 and sum(r.vec_id == 7 for r in got) == 12


def test_ties_and_few_directions(llm):
    same = [[0.5, -0.25, 1.0]] * 9
    assert whitening.report(_frame(llm, same)).collect() == []
    assert whitening.report(_frame(llm, [[1.0, 2.0]])).collect() == []
    assert whitening.report(_frame(llm, [None, None])).collect() == []
    assert whitening.report(_frame(llm, same).limit(0)).collect() == []
    line = [[float(k), 2.0 * k, 0.0] for k in range(20)]
    check(whitening.report(_frame(llm, line)).collect(), line, range(20))
    # equal eigenvalues: any choice of components has the identity as covariance
    square = [[float(a), float(b), float(c)] for a in (0, 1) for b in (0, 1) for c in (0, 1)] * 3
    got = whitening.report(_frame(llm, square)).collect()
    out = np.zeros((24, 3))
    for r in got:
        out[r.vec_id, r.component - 1] = r.whitened
    assert len(got) == 72 and np.abs(out.T @ out / 24 - np.eye(3)).max() < 1e-12
    # n x - S, rounded down to integers, centred: no direction is lost to the offset
    assert all(r.identity_error < 1e-12 for r in got)
    wide = np.eye(70).tolist() * 2  # fewer vectors than dimensions, 69 equal eigenvalues
    got = whitening.report(_frame(llm, wide)).collect()
    assert len(got) == 140 * 32 and all(r.identity_error < 1e-10 for r in got)


def test_hot_vector(llm):
    """A vector that a third of all rows hold."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((600, 20)).astype(np.float32).tolist()
    vectors[:200] = [vectors[0]] * 200
    random.Random(1).shuffle(vectors)
    check(whitening.report(_frame(llm, vectors)).collect(), vectors, range(600))


def test_deviation_is_exact_or_null():
    model = whitening.Model(10 ** 6, 2, [3 * 10 ** 6 + 5, 10 ** 12], 1 << 45, 1.0, np.ones(1), np.ones((2, 1)))
    x = np.array([[1 << 40, 5], [3, 10 ** 6]])
    big, small = ((10 ** 6 * int(a) - 3 * 10 ** 6 - 5) ** 2 + (10 ** 6 * int(b) - 10 ** 12) ** 2 for a, b in x)
    assert big >= 1 << 63 and whitening.deviations(x, model).to_pylist() == [None, small]


def test_columns(llm):
    df = _frame(llm, [[1.0, 2.0], [2.0, 1.0], [0.0, 0.5]])
    model = whitening.fit(df)
    assert whitening.whiten(df, model, ["vec_id", "label"]).columns == ["vec_id", "label", "deviation", "whitened"]
    with pytest.raises(ValueError):
        whitening.whiten(df, model, ["deviation"])
