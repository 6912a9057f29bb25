"""Benchmark decontamination (6) by winnowing.

Words of both sides become K-word grams; of every run of ``WINDOW - K + 1``
grams the smallest hash is kept as a fingerprint, so two texts that share
WINDOW consecutive words share a fingerprint at the same place in it. Test
fingerprints are joined with the documents' ones, and each hit is extended to
the left and right over equal words; a common run of WINDOW words or more
marks its words as hit. An item of fewer words has one fingerprint, of all its
words, which documents are matched against at that length.

The test side is turned into sorted arrays that are broadcast, which is done
only while they hold at most ``BROADCAST_WORDS`` words; a larger benchmark is
handled in that many-word slices, one pass over the documents each, and the
passes' hits are united.

Null and empty texts have no words: a document without words is clean, an item
without words matches nothing. Repeated items each count. Extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WINDOW = 10
K = 5
BROADCAST_WORDS = 4_000_000


def winnow(h: np.ndarray, ok: np.ndarray, of_doc: np.ndarray, run: int) -> np.ndarray:
    """Places of the smallest gram in every run of ``run`` grams of a document
    (the last one on ties). Grams that aren't ok (cut off by the document's
    end) take part in no run."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = ok[run - 1:]  # the run's last gram is whole, and in the same document as the first
    doc = np.repeat(np.arange(len(of_doc) - 1), np.diff(of_doc))
    whole = np.flatnonzero(whole & (doc[:n] == doc[run - 1:]))
    low = h[whole]
    at = whole.copy()
    for j in range(1, run):
        x = h[whole + j]
        less = x <= low
        low = np.where(less, x, low)
        at = np.where(less, whole + j, at)
    return np.unique(at)


class Items:
    """The test side: word hashes of all items in one array, fingerprints sorted by hash."""

    def __init__(self, ids: np.ndarray, column: pa.Array, window: int = WINDOW, k: int = K):
        data, offs = B.string_buffers(column)
        data, offs = data[offs[0]:offs[-1]], offs - offs[0]
        w = B.Words(data, offs, B.ALNUM)
        self.window, self.k = window, k
        self.ids, self.of, self.h = ids, w.of_doc, w.hashes(lower=True)
        g, ok = w.grams(self.h, k)
        at = winnow(g, ok, w.of_doc, window - k + 1)
        order = np.argsort(g[at], kind="stable")
        self.print, self.place = g[at][order], at[order]
        self.item = w.doc
        self.short = []  # (length, sorted hashes, items) of those of fewer words than a window
        for size in sorted(set(w.n[(w.n > 0) & (w.n < window)].tolist())):
            items = np.flatnonzero(w.n == size)
            x = B.roll(self.h, size)[w.of_doc[items]]
            order = np.argsort(x, kind="stable")
            self.short.append((size, x[order], items[order]))

    def hits(self, w: B.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, item) of every common run of a block's words."""
        found = [self._long(w, h)]
        for size, prints, items in self.short:
            g, ok = w.grams(h, size)
            at = np.flatnonzero(ok & np.isin(g, prints))
            at, other = pairs(at, g[at], prints)
            found.append((at, at + size, items[other]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _long(self, w: B.Words, h: np.ndarray):
        g, ok = w.grams(h, self.k)
        at = winnow(g, ok, w.of_doc, self.window - self.k + 1)
        at = at[np.isin(g[at], self.print)]
        at, other = pairs(at, g[at], self.print)
        place = self.place[other]
        first, end = w.of_doc[:-1][w.doc[at]], w.of_doc[1:][w.doc[at]]
        ifirst, iend = self.of[:-1][self.item[place]], self.of[1:][self.item[place]]
        reach = self.window - self.k  # a window around the gram needs no more on either side
        left, right = (np.zeros(len(at), np.int64) for _ in range(2))
        going = np.ones(len(at), bool)
        for j in range(1, reach + 1):
            going &= (at - j >= first) & (place - j >= ifirst)
            x = np.flatnonzero(going)
            going[x] = h[at[x] - j] == self.h[place[x] - j]
            left += going
        same = np.ones(len(at), bool)
        for j in range(self.k):  # the gram itself, word by word
            same &= h[at + j] == self.h[place + j]
        going = same.copy()
        for j in range(self.k, self.window):
            going &= (at + j < end) & (place + j < iend)
            x = np.flatnonzero(going)
            going[x] = h[at[x] + j] == self.h[place[x] + j]
            right += going
        good = same & (left + self.k + right >= self.window)
        return (at - left)[good], (at + self.k + right)[good], self.item[place][good]


def pairs(at: np.ndarray, key: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (place, table row) with equal keys; table is sorted."""
    lo, hi = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
    n = hi - lo
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.repeat(at, n), rows


def covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Flags of n words that lie in any of the runs."""
    step = np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def _pass(docs: DataFrame, items: Items, columns: list[str], runs: bool) -> DataFrame:
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_words long, n_hit long, items array<long>"
    schema += ", runs array<int>" if runs else ""

    def run(batches):
        for batch in batches:
            for i, j, data, offs in B.blocks(batch.column("text")):
                w = B.Words(data, offs, B.ALNUM)
                h = w.hashes(lower=True)
                first, end, item = items.hits(w, h)
                n_hit = B.per_doc(covered(first, end, len(h)), w)
                lists = [[] for _ in range(j - i)]
                both = np.unique(np.stack([w.doc[first], item]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
                for d, x in both.T.tolist():
                    lists[d].append(int(items.ids[x]))
                out = [batch.column(c).slice(i, j - i) for c in columns]
                out += [pa.array(w.n), pa.array(n_hit), pa.array(lists, pa.list_(pa.int64()))]
                if runs:
                    flat = [[] for _ in range(j - i)]
                    for d, a, b in zip(w.doc[first].tolist(), first.tolist(), end.tolist(), strict=True):
                        flat[d] += [a - int(w.of_doc[d]), b - int(w.of_doc[d])]
                    out.append(pa.array(flat, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "n_words", "n_hit", "items", *["runs"] * runs])

    needed = columns if "text" in columns else [*columns, "text"]
    return docs.select(*needed).mapInArrow(run, schema)


def slices(benchmark: DataFrame, words: int) -> list[DataFrame]:
    """The benchmark in slices of about ``words`` words; most often one."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    bench = bench.where("item_id is not null and text is not null")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (words * 4)))  # a word and its separator are 4 characters or more on average
    return [bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == s) if n > 1 else bench for s in range(n)]


def load(bench: DataFrame) -> Items:
    table = bench.orderBy("item_id", "text").toArrow()
    return Items(np.asarray(table.column("item_id"), np.int64), table.column("text").combine_chunks()
                 if table.num_rows else pa.array([], pa.string()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None,
                  words: int = BROADCAST_WORDS) -> DataFrame:
    """``columns`` (default doc_id) with n_words, n_hit and items (sorted ids of
    the items with an occurring window) for every document."""
    columns = columns or ["doc_id"]
    parts = [load(s) for s in slices(benchmark, words)]
    if len(parts) == 1:
        return _pass(docs, parts[0], columns, False)
    # Several passes: number the rows by content, unite the passes' runs.
    keyed = docs.select("doc_id", F.struct(*columns).alias("row"), "text")
    found = reduce(DataFrame.unionByName, [_pass(keyed, p, ["doc_id", "row"], True) for p in parts])
    merged = found.groupBy("doc_id", "row").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"),
        F.flatten(F.collect_list("runs")).alias("runs"), (F.count("*") / len(parts)).alias("copies"))

    def unite(batches):
        for batch in batches:
            n_hit = []
            for n, runs in zip(batch.column("n_words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                r = np.array(runs, np.int64).reshape(-1, 2)
                n_hit.append(int(covered(r[:, 0], r[:, 1], n).sum()) if len(r) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("n_words"), pa.array(n_hit, pa.int64()),
                 batch.column("items"), batch.column("copies")], ["row", "n_words", "n_hit", "items", "copies"])

    kind = dict(keyed.dtypes)["row"]
    out = merged.mapInArrow(unite, f"row {kind}, n_words long, n_hit long, items array<long>, copies double")
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row.*", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    sorted_ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(sorted_ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The contract's result, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bk AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM bk
), dk AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw)
), hits AS (
  SELECT doc_id, k, n, item_id FROM (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM dk)
  JOIN bw USING (n, g)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
