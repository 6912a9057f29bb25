"""Embedding whitening (12) by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of integer vectors x are found
without forming V: all the driver sees of the data are products V Q with a
block Q of few columns. Each product is one distributed pass: every task centres
its rows and adds up its own XᵀXQ, Spark sums those, and a d x k matrix comes
back, whatever the number of rows.

1. Some Lanczos steps bound the spectrum from below and show where it lies.
2. Cycle: the Chebyshev polynomial that is small on the unwanted interval [low,
   smallest Ritz value of the block] and grows fast above it is applied to the
   block by its three-term recurrence, one pass a degree; QR makes the block
   orthonormal; Rayleigh-Ritz with one more pass gives Ritz pairs and residuals.
3. The cycles end once every wanted pair is certified: its residual, which
   bounds the distance to an eigenvalue, is at ``TOLERANCE`` of the largest
   eigenvalue, and the block, which has ``GUARD`` further columns, holds none above
   the interval's end that isn't below the wanted ones. The degree follows from
   how far the last wanted value stands above the interval.

Data: entries c, as doubles, become x = floor(64 c) + 1000000. Sums of x are
exact integers. Every product is of centred values x - S/n, formed from the
exact n x - S, so the offset costs no digits.

A vector that is null, empty, or holds a null or non-finite entry or one beyond
2^40 is left out, neither fitted nor returned; so are vectors of another
length than the commonest one (the smaller of two equally common). Repeated
vectors count as often as they occur; rows that repeat or lack an id are rows
like others. Directions without variance (eigenvalue at most 1e-12 of the
largest) can't be whitened: they have no component, so there are fewer than
asked for where vectors are short or alike, and no rows where all are equal.
Equal eigenvalues leave their components free; one choice holds for all rows.
``deviation`` beyond a long is null. Extra columns are ignored unless passed through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, remove_tables, tables_folder

COMPONENTS = 32
#: Columns beyond the components wanted.
GUARD = 16
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = float(1 << 40)
TOLERANCE = 1e-13
#: By how much a cycle's filter shall raise the last wanted direction over the others.
GAIN = 1e5
DEGREES = (4, 40)
LANCZOS, CYCLES = 10, 200
RANK = 1e-12


@dataclass
class Model:
    """What a fit gives: of the size of the vectors, not of their number."""

    n: int
    dim: int
    sums: list[int]
    spread: int  # largest x less smallest x
    total: float  # trace of the covariance
    values: np.ndarray = field(repr=False)
    vectors: np.ndarray = field(repr=False)  # dim x components
    identity_error: float = 0.0
    passes: int = 0

    @property
    def middle(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """S - n * middle, below n."""
        return np.array([s % self.n for s in self.sums], np.int64)


def matrices(column: pa.Array):
    """(rows, matrix of x) of each length among a batch's usable vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy()
    size = np.diff(offs)
    size[column.is_null().to_numpy(zero_copy_only=False)] = 0
    values = pc.fill_null(column.values.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        block = values[offs[rows][:, None] + np.arange(d)]
        good = (np.abs(block) <= LARGEST).all(1)  # False for NaN
        yield rows[good], np.floor(SCALE * block[good]).astype(np.int64) + OFFSET


def packed(vectors: DataFrame, column: str) -> DataFrame:
    """(d, n, low, high, sums, x) of the usable vectors, batch by batch: x has the
    matrix's bytes, which Python workers read without a copy."""
    def run(batches):
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                if len(x):
                    yield pa.RecordBatch.from_pydict({
                        "d": [x.shape[1]], "n": [len(x)], "low": [int(x.min())], "high": [int(x.max())],
                        "sums": [x.sum(0).tolist()], "x": [x.astype("<i8").tobytes()]}, schema=shape)

    shape = pa.schema({"d": pa.int64(), "n": pa.int64(), "low": pa.int64(), "high": pa.int64(), "sums": pa.list_(pa.int64()), "x": pa.binary()})
    return vectors.select(column).mapInArrow(run, "d long, n long, low long, high long, sums array<long>, x binary")


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    """x - S/n as doubles: the integer part is taken off exactly."""
    return (x - model.middle) - model.rest / model.n


def deviations(x: np.ndarray, model: Model) -> pa.Array:
    """Sum of (n x - S)^2 over each row, exact; null beyond a long."""
    if model.dim * (model.n * (model.spread + 1)) ** 2 < 1 << 62:
        y = model.n * (x - model.middle) - model.rest
        return pa.array((y * y).sum(1))
    y = model.n * (x - model.middle).astype(object) - model.rest.astype(object)
    out = (y * y).sum(1)
    return pa.array([v if v < 1 << 63 else None for v in out.tolist()], pa.int64())


def _summed(blocks: DataFrame, part, width: int) -> np.ndarray:
    """Sum of the matrices (any rows x width) that ``part(x)`` gives for the blocks,
    as one distributed job: a task adds up its own, Spark sums them by row."""
    names = [f"w{j}" for j in range(width)]

    def run(batches):
        total = None
        for batch in batches:
            for n, d, raw in zip(*(batch.column(c) for c in ("n", "d", "x")), strict=True):
                y = part(np.frombuffer(raw.as_buffer(), "<i8").reshape(n.as_py(), d.as_py()))
                total = y if total is None else total + y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(total[:, j]) for j in range(width))],
                                             names=["i", *names])

    parts = blocks.select("n", "d", "x").mapInArrow(run, "i long, " + ", ".join(f"{w} double" for w in names))
    rows = parts.groupBy("i").agg(*[F.sum(w).alias(w) for w in names]).collect()  # of the vectors' length
    out = np.zeros((len(rows), width))
    for r in rows:
        out[r.i] = r[1:]
    return out


class Products:
    """V Q by passes over the blocks."""

    def __init__(self, blocks: DataFrame, model: Model):
        self.blocks, self.model = blocks, model

    def __call__(self, q: np.ndarray) -> np.ndarray:
        model = self.model
        model.passes += 1

        def part(x):
            y = centred(x, model)
            return y.T @ (y @ q)

        return _summed(self.blocks, part, q.shape[1]) / model.n


def lanczos(product, dim: int, steps: int, rng) -> tuple[np.ndarray, float]:
    """Ritz values of some Lanczos steps, with full reorthogonalisation, and the
    norm of the remainder, by which they can be off."""
    basis, diagonal, beside, remainder = np.zeros((dim, 0)), [], [], 0.0
    v = rng.standard_normal(dim)
    for _ in range(min(steps, dim)):
        v /= np.linalg.norm(v)
        basis = np.column_stack([basis, v])
        w = product(v[:, None])[:, 0]
        diagonal.append(float(v @ w))
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        remainder = float(np.linalg.norm(w))
        if remainder <= 1e-12 * max(map(abs, diagonal)):
            break
        beside.append(remainder)
        v = w
    off = np.diag(beside[:len(diagonal) - 1], 1)
    return np.linalg.eigvalsh(np.diag(diagonal) + off + off.T), remainder


def filtered(product, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The block under the Chebyshev polynomial of [low, high], scaled to about
    one at ``top`` so that nothing overflows."""
    centre, half = (low + high) / 2, max((high - low) / 2, 1e-14 * top)
    sigma = first = half / (top - centre)
    y = (product(q) - centre * q) * (sigma / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - sigma)
        q, y, sigma = y, 2 * (following / half) * (product(y) - centre * y) - sigma * following * q, following
    return y


def subspace(product, dim: int, wanted: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors (dim x wanted)."""
    rng = np.random.default_rng(seed)
    size = min(dim, wanted + GUARD)
    wanted = min(wanted, size)
    ritz, off = lanczos(product, dim, LANCZOS, rng)
    low = max(0.0, float(ritz[0]) - off)
    q = np.linalg.qr(rng.standard_normal((dim, size)))[0]
    best, stale = math.inf, 0
    for cycle in range(CYCLES):
        w = product(q)
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        top = float(values[0])
        if top <= 0:
            break
        residual = np.linalg.norm(w - q * values, axis=0)[:wanted].max()
        # certified; or as near as rounding lets it come
        stale = 0 if residual < best / 2 else stale + 1
        best = min(best, residual)
        if residual <= TOLERANCE * top or (best <= 1e3 * TOLERANCE * top and stale >= 2):
            break
        high = float(values[-1])
        if size == dim or high <= 1e-14 * top:
            continue  # the block holds all directions that have variance
        low = min(low, high)
        half = max((high - low) / 2, 1e-14 * top)
        above = max(1 + 1e-3, (float(values[wanted - 1]) - (low + high) / 2) / half)
        degree = min(DEGREES[1], max(DEGREES[0], math.ceil(math.acosh(GAIN) / math.acosh(above))))
        q = np.linalg.qr(filtered(product, q, low, high, top, degree))[0]
    else:
        raise RuntimeError(f"not certified after {CYCLES} cycles: residual {best:g}")
    return values[:wanted], q[:, :wanted]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The components of all usable vectors; None if there is none. The vectors
    are packed once into the shared folder and removed from it afterwards."""
    spark: SparkSession = vectors.sparkSession
    with tables_folder(spark) as folder:
        blocks = checkpointed(packed(vectors, column))
    try:
        lengths = blocks.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        chosen = lengths.orderBy(F.desc("n"), "d").first()
        if chosen is None:
            return None
        blocks = blocks.where(F.col("d") == chosen.d)
        sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        model = Model(chosen.n, chosen.d, [int(r.s) for r in sums.orderBy("i").collect()], chosen.high - chosen.low,
                      0.0, np.zeros(0), np.zeros((chosen.d, 0)))
        model.total = float(_summed(blocks, lambda x: (centred(x, model) ** 2).sum(0)[:, None], 1).sum()) / model.n
        values, u = subspace(Products(blocks, model), model.dim, components)
        kept = values > RANK * values[0] if values[0] > 0 else np.zeros(len(values), bool)
        model.values, model.vectors = values[kept], u[:, kept]
        if kept.any():
            model.identity_error = _identity_error(blocks, model)
        return model
    finally:
        remove_tables(spark, folder)


def _identity_error(blocks: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(model.values)

    def part(x):
        w = whitened(x, model)
        return np.column_stack([w.T @ w, w.sum(0)])

    both = _summed(blocks, part, k + 1) / model.n
    mean = both[:, k]
    return float(np.abs(both[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whitened(x: np.ndarray, model: Model) -> np.ndarray:
    """Rows of x, centred and projected on the components, at unit variance."""
    return centred(x, model) @ model.vectors / np.sqrt(model.values)


def whiten(vectors: DataFrame, model: Model | None, columns: list[str], column: str = "embedding") -> DataFrame:
    """``columns`` of each usable vector with deviation (long) and whitened, its
    coordinates in the order of the components."""
    if {"deviation", "whitened"} & set(columns):
        raise ValueError("names of the result: deviation, whitened")
    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", deviation long, whitened array<double>"

    def run(batches):
        for batch in batches:
            for rows, x in matrices(batch.column("__vector")):
                if model is None or x.shape[1] != model.dim or not len(x):
                    continue
                w, k = whitened(x, model), len(model.values)
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(c) for c in columns), deviations(x, model),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, max(k, 1))[:len(x) + 1] if k else np.zeros(len(x) + 1), pa.int32()),
                                              pa.array(w.ravel()))],
                    names=[*columns, "deviation", "whitened"])

    return vectors.select(*columns, F.col(column).alias("__vector")).mapInArrow(run, schema)


def report(vectors: DataFrame) -> DataFrame:
    """One row per usable vector and component."""
    model = fit(vectors)
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    share = [float(v) for v in model.values / model.total] if model and len(model.values) else []
    rows = whiten(vectors, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(v) for v in share]).cast("array<double>"), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       explained.alias("explained"), F.lit(error).alias("identity_error"))
