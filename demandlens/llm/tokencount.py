"""Token counts (13) by byte-pair merging with a heap and a linked list.

A piece of text starts as a linked list of its bytes' symbols. A heap holds its
adjacent pairs by merge rank, then place; the lowest is popped again and again
and, where it still stands, joined: one symbol is unlinked and the pairs with
the two neighbours enter the heap. The count is the number of symbols at first
less the number of merges. No list of token ids is made.

A text is cut at the added tokens' strings (each counts one, as by the library's
default), what lies between into pieces by the split pattern. A piece's count
depends on the piece alone, so each worker remembers those of short pieces (at
most ``KEPT``) and a frequent word is merged once a worker; nothing is shuffled.

Null is the empty text with 0 bytes and 0 tokens. A text is never cut short: a
very long one is read piece by piece, and a piece of any length is merged in
n log n. Repeated rows give equal rows, rows without doc_id are counted too.
Extra columns are ignored unless passed through by name; a name that the result
has itself can't be.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import splitter

LIMIT = 512
#: Pieces whose count a worker keeps at most, and their greatest length.
KEPT, KEPT_CHARS = 1 << 19, 48
#: Texts beyond so many characters are read piece by piece instead of as a list.
LONG_CHARS = 1 << 21
RESULT = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}
_PLACE = (1 << 40) - 1


def byte_letters() -> list[str]:
    """The letters that a byte-level vocabulary writes for the 256 bytes: visible
    characters of Latin-1 for themselves, the others in order from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Merges(dict):
    """Counts of pieces, made on demand from a tokenizer file's merges."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        if not plain or spec["normalizer"] or spec["post_processor"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE without normalizer, prefix space, dropout and post-processor is expected")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or word ends with them are not supported")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocab = model["vocab"]
        self.symbol = [vocab[c] for c in byte_letters()]
        # rank of a pair of symbols, and the symbol that each merge makes
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.made.append(vocab[a + b])

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n = count = len(piece)
        symbol, rank = list(map(self.symbol.__getitem__, piece)), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := rank.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, r = top & _PLACE, top >> 40
            j = after[i]
            # a popped pair may have been joined with a neighbour since
            if j >= n or symbol[i] < 0 or rank.get(symbol[i] << 32 | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = self.made[r], -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(symbol[i] << 32 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank.get(symbol[h] << 32 | symbol[i])) is not None:
                heapq.heappush(heap, r << 40 | h)
        return count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece.encode())
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def tokens(self, text: str, pattern: str) -> int:
        """Tokens of a text."""
        total, cut = splitter(pattern), [text]
        if self.added:
            cut = self.added.split(text)
        n = len(cut) - 1
        for part in cut:
            if len(part) <= LONG_CHARS:
                n += sum(map(self.__getitem__, total.findall(part)))
            else:
                n += sum(self[m.group()] for m in total.finditer(part))
        return n


@lru_cache(maxsize=2)
def merges(content: bytes) -> Merges:
    return Merges(content)


def count_tokens(docs: DataFrame, content: bytes, pattern: str, columns: list[str] | None = None, limit: int = LIMIT,
                 text: str = "text") -> DataFrame:
    """``columns`` (default doc_id) with n_bytes (UTF-8), n_tokens and over_limit
    (more than ``limit`` tokens). ``content`` is a tokenizer file's content, whose
    size is that of the vocabulary, whatever the input."""
    columns = columns or ["doc_id"]
    if set(columns) & set(RESULT):
        raise ValueError(f"names of the result: {sorted(set(columns) & set(RESULT))}")
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_bytes long, n_tokens long"

    def run(batches):
        known = merges(content)
        for batch in batches:
            n = [known.tokens(t.as_py() or "", pattern) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=[*columns, "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(*columns, size.alias("n_bytes"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
