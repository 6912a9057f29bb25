"""Rows whose signature occurs more than once, of many that don't.

Nearly all signatures of a corpus occur once, and shuffling a row for each takes
several times the corpus. So the rows are made twice: the first time only digests
are shuffled, four bytes a signature, dealt to parts by its upper bits. A part's
digests that occur twice go into a Bloom filter of bounded size, and the
second time only rows that pass it leave their task. What passes without need
(equal digests of different signatures, false hits) is for the caller's join to
remove; nothing that repeats is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import blocks as B

#: Signatures of a part, about, and the most parts (a power of two).
EACH, PARTS = 1 << 16, 1 << 12
#: Signatures of a task whose digests are sorted at a time.
HELD = 1 << 21
#: Bits of the filter for each digest, and at most (32 MB).
BITS, MOST_BITS = 12, 1 << 28
HASHES = 4
U64 = np.uint64

Make = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def _numbers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32)


def _packed(held: list[np.ndarray], shift: int) -> pa.RecordBatch:
    """(part, digests) of signatures; a third equal one tells nothing more."""
    v = np.sort(np.concatenate(held) >> U64(shift))
    v = v[np.append([True, True], v[2:] != v[:-2])[:len(v)]]
    part = (v >> U64(32)).astype(np.int32)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    offs = (np.append(first, len(v)) * 4).astype(np.int32)
    low = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offs), pa.py_buffer(v.astype(np.uint32))])
    return pa.RecordBatch.from_arrays([pa.array(part[first]), low], names=["part", "low"])


def _place(v: np.ndarray, each: int, j: int) -> np.ndarray:
    """The j-th places of digests, with their part, in a filter of ``each`` bits a part."""
    with np.errstate(over="ignore"):
        h = B.mix(v)
        own = (h & U64(0xFFFFFFFF)) + U64(j) * (h >> U64(32) | U64(1))
    return ((v >> U64(32)) * U64(each) + (own & U64(each - 1))).astype(np.int64)


def of_repeats(rows: DataFrame, make: Make, schema: str, expected: int) -> DataFrame:
    """The record batches that ``make`` gives for each batch of ``rows``, without
    most rows whose ``sig`` (a well-mixed long) occurs once; written to a table.
    ``expected``: signatures there are, about."""
    spark = rows.sparkSession
    parts = min(PARTS, 1 << max(0, expected // EACH).bit_length())
    shift = 32 - (parts.bit_length() - 1)

    def digest(batches):
        held, n = [], 0
        for batch in batches:
            for found in make(batch):
                held.append(np.asarray(found.column("sig")).view(U64))
                n += len(held[-1])
                if n >= HELD:
                    yield _packed(held, shift)
                    held, n = [], 0
        if n:
            yield _packed(held, shift)

    def twice(group: pa.Table) -> pa.Table:
        v = np.sort(_numbers(group.column("low")))
        v = np.unique(v[1:][v[1:] == v[:-1]])
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "low": pa.array([v.tobytes()], pa.binary())})

    found = checkpointed(rows.mapInArrow(digest, "part int, low binary").groupBy("part").applyInArrow(twice, "part int, low binary"))
    total = (found.agg(F.sum(F.octet_length("low"))).first()[0] or 0) // 4
    each = min(MOST_BITS // parts, 1 << (BITS * total // parts + 63).bit_length())

    def bits(batches):
        for batch in batches:
            for part, low in zip(batch.column("part").to_pylist(), batch.column("low").to_pylist(), strict=True):
                own, v = np.zeros(each, bool), np.frombuffer(low, np.uint32).astype(U64) | U64(part << 32)
                for j in range(HASHES):
                    own[_place(v, each, j) - part * each] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["part", "bits"])

    # bounded by MOST_BITS whatever the table's size
    whole = np.zeros((parts, each // 8), np.uint8)
    for r in found.mapInArrow(bits, "part int, bits binary").collect():
        whole[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    known = spark.sparkContext.broadcast(whole.ravel())

    def pick(batches):
        for batch in batches:
            for found in make(batch):
                v = np.asarray(found.column("sig")).view(U64) >> U64(shift)
                at = np.arange(len(v))
                for j in range(HASHES):
                    place = _place(v[at], each, j)
                    at = at[known.value[place >> 3] >> (7 - (place & 7)) & 1 == 1]
                if len(at):
                    yield found.take(pa.array(at))

    out = checkpointed(rows.mapInArrow(pick, schema))
    known.destroy()
    return out
