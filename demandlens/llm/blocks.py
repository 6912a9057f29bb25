"""Vectorised text primitives over Arrow string batches.

A batch's text column is one byte buffer plus offsets; the helpers cut it into
blocks of bounded size and compute word spans, word hashes and word n-gram
hashes with numpy, so no Python object is made per word. A document is never
cut: one longer than the bound is a block of its own.

Hashes are 64-bit: a polynomial over a fixed random byte table, finished with
an avalanche mix. Two different words collide with odds of about 5e-20 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Small enough for a block's arrays to stay in the processor's cache.
BLOCK_BYTES = 128 << 10
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)

#: Separators of `[^\x20\x09-\x0D]+` words.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters, non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _BASE)]), dtype=U64)
            _inverses = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _INVERSE)]), dtype=U64)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, local offsets) of blocks of whole documents."""
    data, offs = string_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


class Words:
    """Words of a block: byte spans and, per document, the range of its words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACE):
        w = is_word[data]
        first = offs[:-1][offs[:-1] < offs[1:]]
        start = w.copy()
        start[1:] &= ~w[:-1]
        start[first] = w[first]
        end = w.copy()
        end[:-1] &= ~w[1:]
        last = offs[1:][offs[:-1] < offs[1:]] - 1
        end[last] = w[last]
        self.data, self.offs = data, offs
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.of_doc = np.searchsorted(self.start, offs)  # document d has words of_doc[d]:of_doc[d+1]
        self.n = np.diff(self.of_doc)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z lower-cased on request)."""
        _grow(len(self.data))
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, U64)
            table = _BYTE[LOWER] if lower else _BYTE
            np.cumsum(table[self.data] * _powers[:len(self.data)], out=total[1:])
            h = (total[self.end] - total[self.start]) * _inverses[self.start]
            return mix(h + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def beginnings(self, sizes, lower: bool = False):
        """For each size, (words of more bytes, hash of their first so many)."""
        _grow(len(self.data))
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, U64)
            table = _BYTE[LOWER] if lower else _BYTE
            np.cumsum(table[self.data] * _powers[:len(self.data)], out=total[1:])
            for k in sizes:
                word = np.flatnonzero(self.end - self.start > k)
                start = self.start[word]
                yield k, (word, mix((total[start + k] - total[start]) * _inverses[start]))

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, for every first word; False in the
        mask where fewer than k words of the document follow."""
        ok = np.arange(len(h)) + k <= np.repeat(self.of_doc[1:], self.n)
        return roll(h, k), ok


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of h[i:i+k] for every i (beyond the end: padding)."""
    with np.errstate(over="ignore"):
        padded = np.concatenate([h, np.zeros(k - 1, U64)])
        out = np.full(len(h), U64(k), U64)
        for j in range(k):
            out = out * U64(0x2545F4914F6CDD1D) + padded[j:j + len(h)]
        return mix(out)


def of_words(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, equal to those of ``Words.hashes``."""
    data = np.frombuffer(b"".join(words), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return Words(data, offs, np.ones(256, bool)).hashes()


def per_doc(flags: np.ndarray, w: Words) -> np.ndarray:
    """Sum of a per-word value for each document of the block."""
    total = np.concatenate([[0], np.cumsum(flags.astype(np.int64))])
    return total[w.of_doc[1:]] - total[w.of_doc[:-1]]


def first_in_doc(w: Words, h: np.ndarray, ok: np.ndarray | None = None):
    """Distinct (document, hash) pairs of a block, sorted: (doc, hash, position, count)."""
    pos = np.flatnonzero(ok) if ok is not None else np.arange(len(h))
    order = pos[np.lexsort((h[pos], w.doc[pos]))]
    d, x = w.doc[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    return d[at], x[at], order, np.diff(np.append(at, len(order))), at
