"""Quality rules (5): gradient-boosted trees over document statistics.

A base rule on fixed statistics rejects first; what it passes is judged by
boosted trees. The trees are trained in numpy on a bounded sample of labelled
rows (histogram splits, Newton leaves, monotonic constraints on chosen
features) and flattened into node arrays, which every task scores with.

Null or empty text: no words, all statistics 0, ``base_failed`` true, not kept.
Repeated rows get equal rows. Extra input columns are ignored by ``judge``.
With no labelled rows (or labels of one class) the verdict is the base rule's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .sampling import labelled_sample

#: Rows the trees are fitted on at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"

_LUT = {
    "symbol": np.isin(np.arange(256), list(SYMBOLS)),
    "lead": (np.arange(256) & 0xC0) != 0x80,  # one per code point
    "digit": np.isin(np.arange(256), list(b"0123456789")),
    "upper": np.isin(np.arange(256), list(range(0x41, 0x5B))),
    "stop": np.isin(np.arange(256), list(b".!?")),
    "punct": np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")),
}

#: Statistics a tree may split on, with the sign of the constraint on P(good):
#: -1 means that a larger value never raises the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_ratio": -1, "upper_ratio": 0, "digit_ratio": 0,
    "punct_ratio": 0, "dup_line_ratio": -1, "repeat_ratio": -1, "distinct_ratio": 0,
    "stop_ratio": 0, "log_lines": 0, "line_words": 0,
}
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE_COLUMNS) + ", base_failed boolean"


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts [docs x 5], features [docs x len(FEATURES)]) of a block."""
    w = B.Words(data, offs)
    h = w.hashes()
    n_docs = len(offs) - 1

    def byte_sum(lut: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(lut[data])])
        return total[offs[1:]] - total[offs[:-1]]

    lead = np.concatenate([[0], np.cumsum(_LUT["lead"][data])])
    word_chars = B.per_doc(lead[w.end] - lead[w.start], w)
    # words in 3-word windows that occur twice or more in their text
    g, ok = w.grams(h, 3)
    _, _, order, count, at = B.first_in_doc(w, g, ok)
    twice = np.zeros(len(h), bool)
    twice[order[np.repeat(count > 1, count)]] = True
    hit = twice.copy()
    hit[1:] |= twice[:-1]
    hit[2:] |= twice[:-2]
    # lines: \n-split, those with a word, equal byte for byte to an earlier one
    lines = B.Words(data, offs, np.arange(256) != 0x0A)
    lh = lines.hashes()
    with_word = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    _, _, _, lcount, lat = B.first_in_doc(lines, lh, with_word)
    n_lines = B.per_doc(with_word, lines)
    distinct = np.zeros(n_docs, np.int64)
    if len(lat):
        ld = lines.doc[np.flatnonzero(with_word)]
        first_doc = ld[np.lexsort((lh[with_word], ld))][lat]
        distinct = np.bincount(first_doc, minlength=n_docs)
    d_words, *_ = B.first_in_doc(w, h)
    distinct_words = np.bincount(d_words, minlength=n_docs)
    base = np.stack([w.n, word_chars, byte_sum(_LUT["symbol"]), n_lines - distinct, B.per_doc(hit, w)], axis=1)
    n, chars = np.maximum(w.n, 1), np.maximum(word_chars, 1)
    sums = {k: byte_sum(v) for k, v in _LUT.items()}
    f = {
        "log_words": np.log1p(w.n), "mean_word": word_chars / n, "symbol_ratio": sums["symbol"] / chars,
        "upper_ratio": sums["upper"] / chars, "digit_ratio": sums["digit"] / chars,
        "punct_ratio": sums["punct"] / chars, "dup_line_ratio": (n_lines - distinct) / np.maximum(n_lines, 1),
        "repeat_ratio": base[:, 4] / n, "distinct_ratio": distinct_words / n,
        "stop_ratio": sums["stop"] / n, "log_lines": np.log1p(n_lines), "line_words": w.n / np.maximum(n_lines, 1),
    }
    return base, np.stack([f[k] for k in FEATURES], axis=1)


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


@dataclass
class Trees:
    """Boosted trees as flat node arrays: node i splits feature[i] at
    threshold[i] into left[i] / right[i]; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float = 0.0
    cut: float = 0.5
    rows: int = 0
    held: dict = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[row, self.feature[node]] <= self.threshold[node]
                node = np.where(go, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 60, depth: int = 3,
              rate: float = 0.15, bins: int = 32, l2: float = 1.0, min_rows: int = 10) -> Trees:
    """Newton boosting on logistic loss. A feature with sign s only splits where
    s * (right - left) >= 0, and children are bounded by the split's midpoint,
    so the whole ensemble is monotonic in it."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)], axis=1)
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(p / (1 - p)))
    raw = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0); threshold.append(0.0); left.append(i); right.append(i); value.append(v)
        return i

    def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        v = float(np.clip(-g / (h + l2), lo, hi))
        node = leaf(v * rate)
        if level == depth or len(rows) < 2 * min_rows:
            raw[rows] += v * rate
            return node
        best = (1e-6, None)
        for j in range(k):
            m = len(edges[j]) + 1
            if m < 2:
                continue
            c = code[rows, j]
            gs, hs, ns = (np.bincount(c, w, m).cumsum()[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            vl, vr = np.clip(-gs / (hs + l2), lo, hi), np.clip(-(g - gs) / (h - hs + l2), lo, hi)
            gain = -(gs * vl + .5 * (hs + l2) * vl**2) - ((g - gs) * vr + .5 * (h - hs + l2) * vr**2) + (g * v + .5 * (h + l2) * v**2)
            gain[(ns < min_rows) | (len(rows) - ns < min_rows) | (signs[j] * (vr - vl) < 0)] = 0
            b = int(gain.argmax())
            if gain[b] > best[0]:
                best = (gain[b], (j, b, float(vl[b]), float(vr[b])))
        if best[1] is None:
            raw[rows] += v * rate
            return node
        j, b, vl, vr = best[1]
        go = code[rows, j] <= b
        mid, s = (vl + vr) / 2, signs[j]
        feature[node], threshold[node] = j, float(edges[j][b])
        left[node] = grow(rows[go], level + 1, mid if s < 0 else lo, mid if s > 0 else hi)
        right[node] = grow(rows[~go], level + 1, mid if s > 0 else lo, mid if s < 0 else hi)
        return node

    for _ in range(n_trees):
        q = 1 / (1 + np.exp(-raw))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-9)
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
    as_f, as_i = (lambda v: np.array(v, float)), (lambda v: np.array(v, np.int64))
    return Trees(as_i(feature), as_f(threshold), as_i(left), as_i(right), as_f(value), as_i(roots), depth, bias, rows=n)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, clean_recall: float = 0.995) -> Trees | None:
    """Fit on at most ``train_rows`` labelled documents. The cut is the score
    that keeps ``clean_recall`` of the good ones among a fifth held out."""
    sample = labelled_sample(docs, labels, "quality", train_rows)

    def features(batches):
        for batch in batches:
            good = np.asarray(batch.column("target"), dtype=np.int64)
            for i, j, data, offs in B.blocks(batch.column("text")):
                _, f = statistics(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(good[i:j]), pa.array(list(f), pa.list_(pa.float64()))], ["good", "f"])

    rows = sample.mapInArrow(features, "good long, f array<double>").toArrow()
    y = np.asarray(rows.column("good"), dtype=float)
    if len(y) < 50 or y.min() == y.max():
        return None
    x = np.array(rows.column("f").to_pylist())
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 5 == 0
    trees = fit_trees(x[~held], y[~held], list(FEATURES.values()))
    good = np.sort(trees.score(x[held & (y > 0)]))
    if len(good):
        trees.cut = float(min(0.5, good[int((1 - clean_recall) * len(good))]))
    kept = trees.score(x[held]) >= trees.cut
    trees.held = {"rows": int(held.sum()), "good_kept": float(kept[y[held] > 0].mean()) if len(good) else 1.0,
                  "bad_kept": float(kept[y[held] == 0].mean()) if (y[held] == 0).any() else 0.0}
    return trees


def judge(docs: DataFrame, trees: Trees | None, columns: list[str] | None = None) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, ``score`` and
    ``kept``; ``columns`` are input columns passed through beside them."""
    columns = columns or ["doc_id"]
    kinds = dict(docs.dtypes)
    own = BASE_COLUMNS + ["base_failed", "score", "kept"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", " + ", ".join(
        f"{c} {'boolean' if c in ('base_failed', 'kept') else 'double' if c == 'score' else 'long'}" for c in own)

    def run(batches):
        for batch in batches:
            for i, j, data, offs in B.blocks(batch.column("text")):
                base, x = statistics(data, offs)
                failed = base_failed(base)
                score = trees.score(x) if trees else np.where(failed, 0.0, 1.0)
                kept = ~failed & (score >= (trees.cut if trees else 0.5))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in columns]
                    + [pa.array(base[:, m]) for m in range(5)] + [pa.array(failed), pa.array(score), pa.array(kept)],
                    names=columns + own)

    needed = columns if "text" in columns else [*columns, "text"]
    return docs.select(*needed).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return judge(docs, fit(docs, labels))
