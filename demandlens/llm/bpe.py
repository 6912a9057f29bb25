"""Byte-level BPE encoding and decoding (3) by corpus-level merge replay.

Instead of encoding word after word, a block of documents is cut by the split
pattern, its distinct words are laid out once in one array, and the merges are
replayed over all of them together: an inverted index maps each token pair to
its positions, the pair of lowest rank is taken, applied at all its positions
at once, and only the pairs with the touched neighbours enter the index. A
word's tokens depend on the word alone, so blocks (and tasks) are independent;
a block holds at most ``BLOCK_BYTES`` of text, or one longer document.

Decoding looks the ids' bytes up and concatenates them.

Null is the empty text: no ids. Repeated rows give equal rows. Extra columns
are ignored unless passed through by name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

BLOCK_BYTES = 8 << 20
#: Distinct bytes replayed at once at most (a longer word is replayed by itself).
REPLAY_BYTES = 8 << 20
SPLIT_CHARS = 1 << 19


class Vocabulary:
    """Ranks of a ``.tiktoken`` file as arrays."""

    def __init__(self, content: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = size
        # every way to make a token from two tokens: pair key -> rank of the result
        keys, results = [], []
        for t, r in ranks.items():
            for c in range(1, len(t)):
                a, b = ranks.get(t[:c]), ranks.get(t[c:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    results.append(r)
        order = np.argsort(keys)
        self.key = np.array(keys, np.int64)[order]
        self.result = np.array(results, np.int64)[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token made of a and b; ``size`` where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.result[at], self.size)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[ids], n)
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex
    return regex.compile(pattern)


def replay(voc: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words: (ids, offsets). Merges are applied in rank order."""
    lengths = np.array([len(w) for w in words], np.int64)
    # one position per byte, and one that never merges (-1) after each word
    ends = np.cumsum(lengths + 1) - 1
    total = int(ends[-1]) + 1 if len(words) else 0
    tok = np.full(total, -1, np.int32)
    inside = np.ones(total, bool)
    inside[ends] = False
    tok[inside] = voc.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
    after[-1:] = total - 1
    before[:1] = 0
    alive = inside.copy()
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    none = voc.size

    def add(at: np.ndarray) -> None:
        """Enter the pairs that start at these positions into the index."""
        r = voc.rank(tok[at], tok[after[at]])
        good = r < none
        if not good.any():
            return
        at, r = at[good], r[good]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cut = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(heap, rank)

    start = np.flatnonzero(inside)
    for k in range(0, len(start), 1 << 18):
        add(start[k:k + (1 << 18)].astype(np.int32))
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
        at = at[alive[at]]
        nxt = after[at]
        good = voc.rank(tok[at], tok[nxt]) == rank  # the index may name pairs that are gone
        at, nxt = at[good], nxt[good]
        if len(at) > 1 and (at[1:] == nxt[:-1]).any():
            # overlapping pairs (runs such as aaa): from the left, every second one
            link = np.concatenate([[False], at[1:] == nxt[:-1]])
            start = np.flatnonzero(~link)
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            at, nxt = at[place % 2 == 0], nxt[place % 2 == 0]
        if not len(at):
            continue
        tok[at] = rank
        alive[nxt] = False
        far = after[nxt]
        after[at] = far
        before[far] = at
        prior = before[at]
        touched = np.concatenate([prior[tok[prior] >= 0], at])
        add(np.unique(touched))
    ids = tok[alive]
    count = np.concatenate([[0], np.cumsum(alive)])
    return ids, np.concatenate([[0], count[ends]]) if len(words) else np.zeros(1, np.int64)


def encode_block(voc: Vocabulary, pattern: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts of a block."""
    find = splitter(pattern).findall
    number: dict[str, int] = {}
    refs, counts, begin, size = [], [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SPLIT_CHARS or k + 1 == len(texts):  # the pieces of so many texts at once
            found = [find(t) for t in texts[begin:k + 1]]
            counts += map(len, found)
            for x in dict.fromkeys(chain.from_iterable(found)):
                number.setdefault(x, len(number))
            refs.append(np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int32, sum(map(len, found))))
            begin, size = k + 1, 0
    refs = np.concatenate(refs) if refs else np.zeros(0, np.int32)
    words = [x.encode() for x in number]
    del number
    ids, lens, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            x, offs = replay(voc, group)
            ids.append(x)
            lens.append(np.diff(offs))
        group, size = [], 0

    for x in words:
        if size + len(x) > REPLAY_BYTES:
            flush()
        group.append(x)
        size += len(x)
    flush()
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    n = np.concatenate(lens) if lens else np.zeros(0, np.int64)
    start = np.cumsum(n) - n
    each = n[refs]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[refs], each)
    bounds = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return ids[at], bounds


def encode(docs: DataFrame, content: bytes, pattern: str, columns: list[str] | None = None,
           with_ids: bool = False) -> DataFrame:
    """``columns`` (default doc_id) with n_tokens, ids_sha256, decoded_sha256
    (and the ids on request). ``content`` is the rank file's content, whose
    size is that of the vocabulary, whatever the input."""
    columns = columns or ["doc_id"]
    kinds = dict(docs.dtypes)
    schema = (", ".join(f"`{c}` {kinds[c]}" for c in columns)
              + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    names = [*columns, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        voc = vocabulary(content)
        for batch in batches:
            for i, j, data, offs in B.blocks(batch.column("text"), BLOCK_BYTES):
                raw = data.tobytes()
                o = offs.tolist()
                ids, bounds = encode_block(voc, pattern, [raw[a:b].decode() for a, b in zip(o[:-1], o[1:], strict=True)])
                le = ids.astype("<u4")
                parts = [le[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                out = [batch.column(c).slice(i, j - i) for c in columns] + [
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts]),
                    pa.array([hashlib.sha256(voc.decode(p.astype(np.int64))).hexdigest() for p in parts])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    needed = columns if "text" in columns else [*columns, "text"]
    return docs.select(*needed).mapInArrow(run, schema)
