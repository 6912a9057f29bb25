"""N-gram Jaccard self-join (4) by a partitioned universe.

A document is the set of its word n-grams. Documents with equal sets are one
class, found by a group-by on the set's size and two 64-bit sums. Class
representatives are joined as follows:

* Sizes are cut into bands; a pair above the threshold lies in one band or in
  two adjacent ones, so a document is indexed in its own band and also probes
  the band below.
* In a band with at most H elements of difference, the n-gram universe is
  hashed into m segments. A segment is matched by its subset (covers a
  difference of 0) or by its one-deletion neighbourhood (covers 0 and 1).
  With ``a`` segments of the second kind and up to ``t`` empty subsets left
  out by each side, 2a + (m - a) = H + 1 + 2t guarantees a common signature:
  without one, the segments' differences would add up to more than H.
* ``a`` and ``t`` are chosen for each band from its number of documents and
  mean size, by the cost of signatures plus that of chance candidates.
* Candidates are verified on the whole sets. Rather than all pairs of a
  bucket, each member is first verified against the bucket's smallest member;
  then the bucket's pairs in different components that ``_unruled`` can't rule
  out. Pairs in one component
  can change nothing, so no link between components is lost.

Null and empty texts have empty sets, which are linked with nothing. A doc_id
that occurs with several texts goes by each text. Rows without doc_id keep
their size and get no component. Extra columns are ignored by ``join_report``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import blocks as B
from . import repeats
from .buckets import connect, shared
from .components import components

#: One verified candidate costs as much as so many signatures.
PAIR_COST = 50.0
#: Longs of parity bits of a set, and of one with more elements than those have bits.
PARITIES, WIDE = 16, 256
#: Members of a bucket that are compared pair by pair at most.
PAIRED = 4096
U64 = np.uint64


@dataclass(frozen=True)
class Measure:
    """Word class, n-gram length and similarity threshold of a join."""

    n: int = 3
    threshold: Fraction = Fraction(9, 10)
    lower: bool = True
    alnum: bool = False

    def sets(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a block's documents as (doc, hash), sorted; a
        text of fewer words has its whole sequence as one."""
        w = B.Words(data, offs, B.ALNUM if self.alnum else B.SPACE)
        h = w.hashes(lower=self.lower)
        g, ok = w.grams(h, self.n)
        for size in range(1, self.n):
            short = w.of_doc[:-1][w.n == size]
            if len(short):
                g[short], ok[short] = B.roll(h, size)[short], True
        d, x, *_ = B.first_in_doc(w, g, ok)
        return d, x

    def bands(self, largest: int) -> np.ndarray:
        """Smallest size of each band, up to one above ``largest``."""
        edges = [1, 2]
        while edges[-1] <= largest:
            edges.append(max(edges[-1] + 1, int((edges[-1] - 1) / self.threshold) + 1))
        return np.array([*edges, edges[-1] * 2], np.int64)

    def difference(self, size: int) -> int:
        """Most elements by which a set of ``size`` and a larger linked one differ."""
        return int((1 - self.threshold) / self.threshold * size)


def allocate(measure: Measure, edges: np.ndarray, counts: dict[int, tuple[int, float]]) -> np.ndarray:
    """For each band (segments m, one-deletion segments a, skipped empties t);
    m = 0 where only equal sets can be linked. ``counts``: band -> (documents
    in it and the next, mean size)."""
    out = np.zeros((len(edges), 3), np.int64)
    for band in range(len(edges) - 1):
        h = measure.difference(int(edges[band + 1]) - 1)
        if h < 1:
            continue
        n_docs, size = counts.get(band, (0, float(edges[band])))
        best = None
        for t in range(4):
            v = h + 1 + 2 * t
            for a in range(min(2, v // 2) + 1):
                m = v - a
                lam = size / m
                empties = (m - a) * math.exp(-lam)  # a document's mean number of empty subsets
                more = 1 - sum(math.exp(-empties) * empties**i / math.factorial(i) for i in range(t + 1))
                chance = n_docs * max(more, 0) ** 2 * min(1, (t + 1 + empties) / m)
                cost = (m - a) + a * (1 + lam) + PAIR_COST * chance
                if best is None or cost < best[0]:
                    best = (cost, (m, a, t))
        out[band] = best[1]
    return out


def signatures(d: np.ndarray, x: np.ndarray, target: np.ndarray, plan: np.ndarray):
    """(document, signature) of sets (d, x) in each document's target band
    (negative: none); ``plan`` as from ``allocate``."""
    m_doc = np.where(target >= 0, plan[np.maximum(target, 0), 0], 0)
    live = m_doc[d] > 0
    d, x = d[live], x[live]
    with np.errstate(over="ignore"):
        salt = B.mix(target.astype(U64) + U64(1))
        seg = ((B.mix(x ^ salt[d]) >> U64(32)) * m_doc[d].astype(U64) >> U64(32)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(m_doc)])
        total = np.zeros(base[-1], U64)
        at = base[d] + seg
        np.add.at(total, at, x)
        filled = np.bincount(at, minlength=base[-1])
        doc = np.repeat(np.arange(len(m_doc)), m_doc)
        no = np.arange(base[-1]) - base[doc]
        deletion = no < plan[np.maximum(target, 0), 1][doc]
        empty = (filled == 0) & ~deletion
        rank = np.cumsum(empty)
        before = np.concatenate([[0], rank])[base[:-1]]
        skip = empty & (rank - before[doc] <= plan[np.maximum(target, 0), 2][doc])
        place = B.mix(salt[doc] + no.astype(U64) * U64(2) + deletion.astype(U64))
        sig = B.mix(total + place)
        one = np.flatnonzero(deletion[at])
        sig_del = B.mix(total[at[one]] - x[one] + place[at[one]])
    return np.concatenate([doc[~skip], d[one]]), np.concatenate([sig[~skip], sig_del])


#: Columns of a set's size and parities.
SKETCH = ["n_shingles", *(f"p{k}" for k in range(PARITIES)), "wide"]


def _summary(docs: DataFrame, measure: Measure, columns: list[str]) -> DataFrame:
    """``columns`` with n_shingles, two sums s1, s2 that stand for the set, its
    parities p0, p1, ... and, of a large one, ``wide``."""
    kinds = dict(docs.dtypes)
    names = [*columns, "s1", "s2", *SKETCH]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", s1 long, s2 long, n_shingles long, " + ", ".join(
        f"p{k} long" for k in range(PARITIES)) + ", wide array<long>"

    def run(batches):
        for batch in batches:
            for i, j, data, offs in B.blocks(batch.column("text")):
                d, x = measure.sets(data, offs)
                sums = np.zeros((2, j - i), U64)
                with np.errstate(over="ignore"):
                    np.add.at(sums[0], d, x)
                    np.add.at(sums[1], d, B.mix(x ^ U64(0x5851F42D4C957F2D)))
                bits, n = parities(d, x, j - i), np.bincount(d, minlength=j - i)
                # large sets fill the short bits; they have long ones too
                large = np.flatnonzero(n > 64 * PARITIES)
                kept = n[d] > 64 * PARITIES
                long = parities(np.searchsorted(large, d[kept]), x[kept], len(large), WIDE).T
                offs_wide = np.concatenate([[0], np.cumsum(np.where(n > 64 * PARITIES, WIDE, 0))]).astype(np.int32)
                wide = pa.ListArray.from_arrays(pa.array(offs_wide), pa.array(np.ascontiguousarray(long).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in columns] + [pa.array(s.view(np.int64)) for s in sums]
                    + [pa.array(n)] + [pa.array(np.ascontiguousarray(b)) for b in bits] + [wide], names=names)

    needed = columns if "text" in columns else [*columns, "text"]
    return docs.select(*needed).mapInArrow(run, schema)


def _signature_rows(docs: DataFrame, measure: Measure, edges: np.ndarray, plan: np.ndarray, expected: int) -> DataFrame:
    """(sig, node, own) of the signatures that several documents may have."""
    def make(batch):
        for i, j, data, offs in B.blocks(batch.column("text")):
            d, x = measure.sets(data, offs)
            n = np.bincount(d, minlength=j - i)
            own = np.searchsorted(edges, n, "right") - 1
            ids = np.asarray(batch.column("doc_id").slice(i, j - i), np.int64)
            for low in (0, 1):
                doc, sig = signatures(d, x, own - low, plan)
                for k in range(0, len(doc), 1 << 17):
                    at = doc[k:k + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig[k:k + (1 << 17)].view(np.int64)), pa.array(ids[at]), pa.array(np.full(len(at), low == 0))],
                        names=["sig", "node", "own"])

    return repeats.of_repeats(docs.select("doc_id", "text"), make, "sig long, node long, own boolean", expected)


def parities(d: np.ndarray, x: np.ndarray, docs: int, longs: int = PARITIES) -> np.ndarray:
    """(longs, documents): bit i tells whether an odd number of a set's
    elements falls on i. Two sets' bits differ in no more places than the sets in
    elements, so too many different bits rule a pair out."""
    size = 64 * longs
    at = (B.mix(x) % U64(size)).astype(np.int64)
    odd = np.bincount(d * size + at, minlength=docs * size).reshape(docs, size) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64).reshape(docs, longs).T


def _set_rows(docs: DataFrame, measure: Measure) -> DataFrame:
    """(doc_id, grams) of the documents."""
    def run(batches):
        for batch in batches:
            for i, j, data, offs in B.blocks(batch.column("text")):
                d, x = measure.sets(data, offs)
                lists = pa.LargeListArray.from_arrays(
                    pa.array(np.searchsorted(d, np.arange(j - i + 1))), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists.cast(pa.list_(pa.int64()))], ["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


@dataclass(frozen=True)
class Sets:
    """The documents' sets: small ``sketches`` (doc_id and ``SKETCH``) of all, whole sets
    made from ``docs`` (doc_id, text) for those that are asked for."""

    sketches: DataFrame
    docs: DataFrame
    measure: Measure

    def small(self, node: str, h: str) -> DataFrame:
        """(node, h): each set's size and parities."""
        return self.sketches.select(F.col("doc_id").alias(node), F.struct(
            F.col("n_shingles").alias("n"), *[f"p{k}" for k in range(PARITIES)]).alias(h))

    def whole(self, nodes: DataFrame) -> DataFrame:
        """(doc_id, grams) of the documents in the first column of ``nodes``."""
        wanted = checkpointed(nodes.toDF("doc_id").distinct())
        return checkpointed(_set_rows(self.docs.join(wanted, "doc_id", "left_semi"), self.measure))


def _possible(x: str, y: str, measure: Measure):
    """Whether the parities of two sets leave a link possible."""
    apart = sum((F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}"))) for k in range(PARITIES)), F.lit(0))
    return apart <= _most(x, y, measure)


def _most(x: str, y: str, measure: Measure):
    """Most elements in which two linked sets differ."""
    t = measure.threshold
    return F.floor((F.col(f"{x}.n") + F.col(f"{y}.n")) * (t.denominator - t.numerator) / (t.denominator + t.numerator) + 1e-9)


def _verified(pairs: DataFrame, sets: Sets, measure: Measure) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, on the whole sets. Most
    candidates are ruled out by their parities, so whole sets are made of few."""
    pairs = (pairs.join(sets.small("b", "y"), "b").join(sets.small("a", "x"), "a").where(_possible("x", "y", measure))
             .select("a", "b", F.least("x.n", "y.n").alias("n"), _most("x", "y", measure).alias("most")).distinct())
    long = sets.sketches.where(F.size("wide") > 0).select("doc_id", "wide")
    apart = F.aggregate(F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, k: total + k)
    both_large = F.col("n") > 64 * PARITIES
    pairs = checkpointed(pairs)
    pairs = (pairs.where(both_large).join(long.toDF("b", "y"), "b").join(long.toDF("a", "x"), "a").where(apart <= F.col("most"))
             .select("a", "b").unionByName(pairs.where(~both_large).select("a", "b")).distinct())
    pairs = checkpointed(pairs)
    whole = sets.whole(pairs.select(F.explode(F.array("a", "b"))))
    left = whole.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    right = whole.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    num, den = measure.threshold.numerator, measure.threshold.denominator
    return (pairs.join(right, "b").join(left, "a")
            .where(den * both >= num * (F.size("ga") + F.size("gb") - both)).select("a", "b"))


def _rest(left: DataFrame, sets: Sets, measure: Measure) -> DataFrame:
    """Pairs of different components among the members of buckets that have several:
    in buckets of few members those that the parities leave, and in larger ones those
    that ``_unruled`` leaves."""
    large = checkpointed(left.groupBy("sig").agg(F.count("*").alias("k")).where(F.col("k") > PAIRED).select("sig"))
    few = (left.join(large, "sig", "left_anti").select("sig", "node", "part", "own")
           .join(sets.small("node", "h"), "node"))
    p, q = few.alias("p"), few.alias("q")
    pairs = (p.join(q, (F.col("p.sig") == F.col("q.sig")) & F.expr("p.own and p.part != q.part and (not q.own or p.node < q.node)")
                    & _possible("p.h", "q.h", measure)))
    return _ends(pairs).unionByName(_unruled(checkpointed(left.join(large, "sig", "left_semi")), sets, measure)).distinct()


def _unruled(left: DataFrame, sets: Sets, measure: Measure) -> DataFrame:
    """Pairs of different components in a bucket that may be linked.

    Members are compared by what tells them from their bucket's rep: D(x), the
    elements in only one of x and the rep. x and y differ in |D(x)| + |D(y)| -
    2 |D(x) & D(y)| elements, of which a link allows H at most. Who isn't linked
    to the rep has |D| > H, so linked residuals must overlap, by ``need``
    elements at least; then the first |D| - need + 1 elements of both, in one
    order, have one in common. The order is by how often an element is in the
    residuals of a rep, rarest first, so copies of one text that are too far
    apart to be linked don't meet by the changes that most of them share. A
    residual is bounded by its document's and the rep's own size."""
    home = left.where("node = rep").select("rep", F.col("part").alias("home")).distinct()
    rows = left.select("rep", "node", "part", F.col("hint.n").alias("n")).distinct().join(home, "rep")
    whole = sets.whole(rows.select(F.explode(F.array("rep", "node"))))
    x = whole.select(F.col("doc_id").alias("node"), F.col("grams").alias("gx"))
    p = whole.select(F.col("doc_id").alias("rep"), F.col("grams").alias("gp"))
    rows = (rows.where("node != rep").join(x, "node").join(p, "rep")
            .select("rep", "node", "part", "n", (F.col("part") != F.col("home")).alias("out"),
                    F.explode(F.concat(F.array_except("gx", "gp"), F.array_except("gp", "gx"))).alias("e")))
    rows = checkpointed(rows)
    often = rows.groupBy("rep", "e").agg(F.count("*").alias("times"))
    rows = (rows.join(often, ["rep", "e"]).groupBy("rep", "node", "part", "n", "out")
            .agg(F.array_sort(F.collect_list(F.struct("times", "e"))).alias("rest")))
    rows = checkpointed(rows.withColumn("rest", F.col("rest.e")).withColumn("d", F.size("rest")))
    least = rows.groupBy("rep").agg(F.min(F.when(F.col("out"), F.col("d"))).alias("d_out"),
                                    F.min(F.when(~F.col("out"), F.col("d"))).alias("d_home"))
    t = measure.threshold
    most = F.floor(F.col("n") * (t.denominator - t.numerator) / t.numerator + 1e-9).cast("int")
    rows = rows.join(least.where("d_out is not null"), "rep")

    def prefix(rows: DataFrame, other: str) -> DataFrame:
        need = F.greatest(F.lit(1), F.ceil((F.col("d") + F.col(other) - most) / 2).cast("int"))
        first = F.slice("rest", F.lit(1), F.greatest(F.col("d") - need + 1, F.lit(0)))
        return rows.select("rep", "node", "part", "n", "d", F.posexplode(first).alias("i", "e"))

    # The first element two residuals share, at places i and j, leaves room for
    # 1 + min(d - i, d - j) common ones (places from 0: without the 1 +).
    room = F.least(F.col("p.d") - F.col("p.i"), F.col("q.d") - F.col("q.i"))
    allowed = F.floor((F.col("p.n") + F.col("q.n")) * (t.denominator - t.numerator) / (t.denominator + t.numerator) + 1e-9)
    same = ((F.col("p.rep") == F.col("q.rep")) & (F.col("p.e") == F.col("q.e")) & (F.col("p.part") != F.col("q.part"))
            & (2 * room >= F.col("p.d") + F.col("q.d") - allowed))
    outer = prefix(rows.where("out"), "d_out")
    pairs = outer.alias("p").join(outer.alias("q"), same & (F.col("p.node") < F.col("q.node")))
    across = (prefix(rows.where("out and d_home is not null"), "d_home").alias("p")
              .join(prefix(rows.where("not out"), "d_out").alias("q"), same))
    return _ends(pairs).unionByName(_ends(across)).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame | None:
    """Links (a, b) between class representatives that connect all that can be
    connected; None where no two sizes are near enough. ``rows`` has the doc_ids
    and sketches.
    What picks documents by id is written first: Spark then knows its size, and
    where that is small it need not shuffle the texts."""
    sizes = classes.groupBy("n_shingles").agg(F.count("*").alias("docs")).where("n_shingles > 0")
    largest = sizes.agg(F.max("n_shingles")).first()[0] or 0
    edges = measure.bands(largest)
    band = F.lit(-1)  # the number of bands grows with the logarithm of the largest size
    for e in edges.tolist():
        band = band + (F.col("n_shingles") >= e).cast("int")
    by_band = {r["band"]: (r["docs"], r["size"]) for r in sizes.groupBy(band.alias("band")).agg(
        F.sum("docs").alias("docs"), (F.sum(F.col("docs") * F.col("n_shingles")) / F.sum("docs")).alias("size")).collect()}
    counts = {b: (by_band.get(b, (0, 0))[0] + by_band.get(b + 1, (0, 0))[0],
                  by_band.get(b, by_band.get(b + 1, (0, 1.0)))[1]) for b in {*by_band, *(x - 1 for x in by_band)}}
    plan = allocate(measure, edges, counts)
    if not plan[:, 0].any():
        return None
    smallest = int(edges[int(np.argmax(plan[:, 0] > 0))])
    reps = classes.where(F.col("n_shingles") >= smallest).select(F.col("rep").alias("doc_id")).distinct()
    # copies and short texts are mostly fewer than the others
    others = checkpointed(rows.where("doc_id is not null").select("doc_id").distinct().join(reps, "doc_id", "left_anti"))
    rep_docs = docs.select("doc_id", "text").join(others, "doc_id", "left_anti")
    expected = sum(n * int(plan[b, 0] + plan[max(b - 1, 0), 0]) * 2 for b, (n, _) in by_band.items())
    found = shared(_signature_rows(rep_docs, measure, edges, plan, expected))
    sizes = classes.select(F.col("rep").alias("node"), F.struct(F.col("n_shingles").cast("int").alias("n")).alias("hint")).distinct()
    members = checkpointed(found.join(sizes, "node"))
    sets = Sets(rows.where("doc_id is not null").select("doc_id", *SKETCH), docs.select("doc_id", "text"), measure)
    num, den = measure.threshold.numerator, measure.threshold.denominator
    return connect(members, lambda pairs: _verified(pairs, sets, measure),
                   lambda x, y: den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"]),
                   lambda left: _rest(left, sets, measure))


def linked(docs: DataFrame, measure: Measure = Measure(), columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default doc_id) with n_shingles and component_id for every row."""
    columns = columns or ["doc_id"]
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = checkpointed(_summary(keyed, measure, columns))
    key = ["n_shingles", "s1", "s2"]
    classes = checkpointed(rows.where("doc_id is not null and n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")))
    found = links(keyed.where("doc_id is not null"), rows, classes, measure)
    if found is not None:
        parts = components(found)
        classes = (classes.join(parts, classes["rep"] == parts["node"], "left")
                   .select(*key, "rep", F.coalesce("component", "rep").alias("part")))
    else:
        classes = classes.withColumn("part", F.col("rep"))
    return (rows.join(classes, key, "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")))
            .select(*columns, "n_shingles", "component_id"))


def join_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: word 3-grams, similarity of 0.9 or more."""
    return linked(docs)


#: The contract's result, for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') AS g FROM k
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM sides
  UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON reach.other = sides.a
), part AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN part USING (doc_id)
"""
