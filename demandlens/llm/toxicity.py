"""Toxicity (1): counterfactual-regularised classifier.

A logistic regression over a whole text's words, pairs of neighbouring words and
beginnings of words (4 to 8 bytes, so that inflected and compound forms count
together), each as present, present twice or more, and four times or more.
Training texts that name a group get counterfactual copies, in which
every identity term is swapped for another of its kind; the loss adds a
penalty on the squared change of the logit between a text and its copies, so
that naming a group neutrally doesn't move the score.

Fitting takes at most ``TRAIN_ROWS`` labelled rows, those whose doc_id hashes
lowest among the rows allowed for training. The features are the
``FEATURES`` ones of strongest association with the label in that sample
(counted in Spark). Identity terms give no beginnings. Scoring reads all rows; labels, lang, source and
doc_id are no input of a score.

Null and empty texts have no features and get the score of the intercept.
Repeated rows score alike. With no labelled rows, or one class only, the score
is the share of toxic rows (0 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .sampling import labelled_sample

TRAIN_ROWS = 15_000
FEATURES = 1_024
MIN_DOCS = 8
THRESHOLD = 0.3

#: Identity terms by kind; a term is swapped for others of its kind.
IDENTITY = [
    "women men girls boys woman man girl boy female male trans nonbinary",
    "christian muslim jewish hindu buddhist atheist christians muslims jews hindus buddhists atheists",
    "black white asian latino african european arab hispanic indigenous american",
    "gay lesbian straight bisexual queer heterosexual homosexual",
    "immigrant refugee foreigner native citizen migrant",
    "frauen männer mädchen jungen frau mann", "christen muslime juden hindus buddhisten atheisten",
    "schwarze weiße asiaten afrikaner europäer araber",
    "femmes hommes filles garçons femme homme", "chrétiens musulmans juifs bouddhistes athées",
    "noirs blancs asiatiques africains européens arabes",
    "mujeres hombres niñas niños mujer hombre", "cristianos musulmanes judíos budistas ateos",
    "negros blancos asiáticos africanos europeos árabes",
]
#: Swaps made of a text with identity terms: each term for the one so many places on.
SWAPS = (1, 2, 3)


def swap_table(identity: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted term hashes, for each swap the hashes of the replacements)."""
    terms, other = [], []
    for kind in identity:
        words = [w.encode() for w in kind.split()]
        h = B.of_words(words)
        terms.append(h)
        other.append(np.stack([np.roll(h, -k) for k in SWAPS]))
    terms, other = np.concatenate(terms), np.concatenate(other, axis=1)
    terms, first = np.unique(terms, return_index=True)  # a term of two kinds goes with the first
    return terms, other[:, first]


LEVELS = (1, 2, 4)
BEGINNINGS = (4, 5, 6, 7, 8)


class Terms:
    """The identity terms and their swaps, as word hashes."""

    def __init__(self, identity: list[str]):
        self.terms, self.other = swap_table(identity)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is an identity term, its number) of word hashes."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return self.terms[at] == h, at

    def occurrences(self, w: B.Words, swap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of every word, pair and beginning of a block;
        ``swap`` puts identity terms' others in their place."""
        h = w.hashes(lower=True)
        named, at = self.find(h)
        if swap is not None:
            h = np.where(named, self.other[swap][at], h)
        pairs, ok = w.grams(h, 2)
        docs, keys = [w.doc, w.doc[ok]], [h, pairs[ok]]
        for k, x in w.beginnings(BEGINNINGS, lower=True):
            some = x[0][~named[x[0]]], x[1][~named[x[0]]]
            docs.append(w.doc[some[0]])
            keys.append(B.mix(some[1] ^ np.uint64(k)))
        return np.concatenate(docs), np.concatenate(keys)


def counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) with their number of occurrences."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


@dataclass
class Model:
    keys: np.ndarray  # sorted keys
    number: np.ndarray  # [level, key] -> number of the feature, -1 where it is none
    weights: np.ndarray
    bias: float
    terms: Terms
    rows: int = 0
    info: dict = field(default_factory=dict)

    def find(self, w: B.Words, swap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, number) of the features of a block's texts."""
        none = np.zeros(0, np.int64)
        if not len(self.keys):
            return none, none
        doc, key = self.terms.occurrences(w, swap)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = self.keys[at] == key
        doc, at, n = counted(doc[good], at[good])
        found = [(doc[n >= t], self.number[level][at[n >= t]]) for level, t in enumerate(LEVELS)]
        doc, no = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((no, doc))
        order = order[no[order] >= 0]
        return doc[order], no[order]

    def score(self, w: B.Words) -> np.ndarray:
        doc, no = self.find(w)
        logit = self.bias + np.bincount(doc, self.weights[no], minlength=len(w.n))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train_logistic(rows, cols, y, swaps, n_features, l2=0.02, fair=1.0, steps=300, rate=0.1):
    """Adam on mean log loss + l2 |w|^2 + fair * mean squared logit change.
    ``rows, cols``: present features; ``swaps``: (pair no, feature, +1 / -1)."""
    w, b, n = np.zeros(n_features), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), len(y)
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    pair, feature, sign = swaps
    n_pairs = int(pair.max()) + 1 if len(pair) else 0
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(cols, e[rows], minlength=n_features) + 2 * l2 / n_features * w
        if n_pairs:
            change = np.bincount(pair, sign * w[feature], minlength=n_pairs)
            g += 2 * fair / n_pairs * np.bincount(feature, sign * change[pair], minlength=n_features)
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows: int = TRAIN_ROWS,
        identity: list[str] = IDENTITY, n_features: int = FEATURES, fair: float = 1.0) -> Model:
    sample = labelled_sample(docs, labels, "toxic", rows, where)
    terms = Terms(identity)

    def count(batches):
        """Partial counts of a feature's documents and toxic documents."""
        for batch in batches:
            y = np.asarray(batch.column("target"), np.int64)
            for i, j, data, offs in B.blocks(batch.column("text")):
                doc, key, times = counted(*terms.occurrences(B.Words(data, offs, B.ALNUM)))
                for level, t in enumerate(LEVELS):
                    keys, at = np.unique(key[times >= t], return_inverse=True)
                    n = np.bincount(at, minlength=len(keys))
                    pos = np.bincount(at, y[i:j][doc[times >= t]], minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), level)),
                                                      pa.array(n), pa.array(pos)], ["key", "level", "n", "pos"])

    total = sample.agg(F.count("*"), F.sum("target")).first()
    n, toxic = int(total[0]), int(total[1] or 0)
    none = np.zeros(0, np.uint64)
    share = min(max(toxic / n if n else 0.0, 1e-9), 1 - 1e-9)
    base = Model(none, np.zeros((len(LEVELS), 0), np.int64), np.zeros(0), float(np.log(share / (1 - share))), terms, n)
    if n < 50 or toxic in (0, n):
        return base
    # z-score of the label's share among a feature's documents
    z = (F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = (sample.mapInArrow(count, "key long, level long, n long, pos long").groupBy("key", "level")
            .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= MIN_DOCS)
            .where(F.abs(z) >= 3).orderBy(F.abs(z).desc(), "key", "level").limit(n_features).select("key", "level").toArrow())
    if not best.num_rows:
        return base
    keys = np.asarray(best.column("key"), np.int64).view(np.uint64)
    table = np.unique(keys)
    number = np.full((len(LEVELS), len(table)), -1)
    number[np.asarray(best.column("level")), np.searchsorted(table, keys)] = np.arange(len(keys))
    model = Model(table, number, np.zeros(len(keys)), base.bias, terms, n)

    def rows_of(batches):
        for batch in batches:
            y = np.asarray(batch.column("target"), np.int64)
            for i, j, data, offs in B.blocks(batch.column("text")):
                w = B.Words(data, offs, B.ALNUM)
                h = w.hashes(lower=True)
                named = np.unique(w.doc[terms.find(h)[0]])
                found = [model.find(w), *(model.find(w, k) for k in range(len(SWAPS) if len(named) else 0))]
                cuts = [np.searchsorted(f[0], np.arange(j - i + 1)) for f in found]
                swapped = [[] for _ in range(j - i)]
                for d in named.tolist():
                    swapped[d] = [f[1][c[d]:c[d + 1]].tolist() for f, c in zip(found[1:], cuts[1:], strict=True)]
                with np.errstate(over="ignore"):  # a key of the text, to put the rows in one order
                    key = np.zeros(j - i, np.uint64)
                    np.add.at(key, w.doc, B.mix(h + np.arange(len(h)).astype(np.uint64) - w.of_doc[w.doc].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(y[i:j]),
                     pa.ListArray.from_arrays(pa.array(cuts[0].astype(np.int32)), pa.array(found[0][1])),
                     pa.array(swapped, pa.list_(pa.list_(pa.int64())))], ["key", "y", "x", "swapped"])

    got = sample.mapInArrow(rows_of, "key long, y long, x array<long>, swapped array<array<long>>").toArrow().sort_by(
        [("key", "ascending"), ("y", "ascending")]).combine_chunks()
    y = np.asarray(got.column("y"), float)
    x = got.column("x").combine_chunks()
    row, col = np.repeat(np.arange(len(y)), np.diff(np.asarray(x.offsets))), np.asarray(x.flatten(), np.int64)
    pair, feature, sign, n_pairs = [], [], [], 0
    has = np.flatnonzero(np.diff(np.asarray(got.column("swapped").combine_chunks().offsets)))
    for k in has.tolist():
        own = set(x[k].as_py())
        for copy in got.column("swapped")[k].as_py():
            for f, v in [(f, 1.0) for f in own - set(copy)] + [(f, -1.0) for f in set(copy) - own]:
                pair.append(n_pairs)
                feature.append(f)
                sign.append(v)
            n_pairs += 1
    # pairs that change no feature change no score and add nothing to the penalty
    seen, pair = np.unique(np.array(pair, np.int64), return_inverse=True)
    model.weights, model.bias = train_logistic(row, col, y, (pair, np.array(feature, np.int64), np.array(sign)), len(keys), fair=fair)
    model.info = {"counterfactuals": n_pairs, "that change a feature": len(seen)}
    return model


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default doc_id) and the score of every row."""
    columns = columns or ["doc_id"]
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            for i, j, data, offs in B.blocks(batch.column("text")):
                w = B.Words(data, offs, B.ALNUM)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in columns] + [pa.array(model.score(w))],
                    names=[*columns, "score"])

    needed = columns if "text" in columns else [*columns, "text"]
    return docs.select(*needed).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
