"""Fill-in-middle transformation (11) by displacement scatter.

A text is cut into tokens, runs of the letters A-Z and a-z or single other code
points. Two cuts drawn from the document's id part it into prefix, middle and
suffix, which are put out in another order with sentinels before them.

No text is taken apart and joined again. All texts of a block lie in one byte
array; the cuts are found by counting token starts, and each text's moves are
entered into a difference array over the block's bytes: at the first byte of
prefix, middle and suffix, by how much farther the bytes are moved from there
on. Its cumulative sum is every byte's displacement, and one scatter writes the
whole block's output, the sentinels then filling the gaps. ``restore`` finds the
sentinels in an output, enters the inverse displacements and gathers the text
back. Both sum in windows, so that a very long text needs a few times its size.

Draws: h1 to h4 are the first four 8-digit groups of the hex sha256 of
``seed:doc_id``. With n tokens the cuts stand before tokens h1 % (n + 1) and
h2 % (n + 1); h3 % 100 >= ``rate`` leaves a text plain, else h4 % 100 < ``spm``
takes the order suffix, prefix, middle.

Null is the empty text. Plain (put out as it is) are also empty texts, texts
that hold a sentinel and rows without doc_id, which have no draws. Rows that
repeat a doc_id have the same draws, equal rows equal results. A text is never
cut short; one longer than a block is a block of its own. Extra columns are
ignored unless passed through by name; a name that the result has itself can't be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BLOCK_BYTES = 1 << 20
#: Displacements summed at once.
WINDOW = 1 << 18
MARKS = (b"<P>", b"<S>", b"<M>")
RATE, SPM = 90, 20
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM_FORM = range(3)
#: Sentinels before the three parts of an output, by form.
ORDER = {PSM: (0, 1, 2), SPM_FORM: (1, 0, 2)}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False

RESULT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def token_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which the block's tokens start."""
    letter = _LETTER[data]
    start = _LEAD[data]
    start[1:] &= ~(letter[1:] & letter[:-1])
    first = offs[:-1][offs[:-1] < offs[1:]]
    start[first] = True
    return np.flatnonzero(start)


def marks_in(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, byte position, which) of the sentinels inside the block's texts."""
    at = np.flatnonzero(data[:-2] == MARKS[0][0]) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[data[at + 2] == MARKS[0][2]]
    which = np.full(len(at), -1)
    for k, mark in enumerate(MARKS):
        which[data[at + 1] == mark[1]] = k
    doc = np.searchsorted(offs, at, "right") - 1
    good = (which >= 0) & (at + 3 <= offs[doc + 1])
    return doc[good], at[good], which[good]


def displacements(size: int, at: np.ndarray, by: np.ndarray):
    """(window's start, displacement of each of its bytes): the cumulative sums
    of a difference array that holds ``by[i]`` at ``at[i]``, window by window."""
    order = np.argsort(at, kind="stable")
    at, by = at[order], by[order]
    carry = 0
    for a in range(0, size, WINDOW):
        b = min(size, a + WINDOW)
        lo, hi = np.searchsorted(at, (a, b))
        d = np.zeros(b - a, np.int64)
        np.add.at(d, at[lo:hi] - a, by[lo:hi])
        d[0] += carry
        d = np.cumsum(d)
        carry = int(d[-1])
        yield a, d


def _changes(start: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference array entries for pieces that begin at ``start`` (ascending,
    empty pieces included: the last one at a place counts) and move by ``shift``."""
    return start, np.diff(shift, prepend=0)


def arrange(data: np.ndarray, offs: np.ndarray, draws: np.ndarray, drawn: np.ndarray, rate: int, spm: int):
    """The block's outputs: (n, form, prefix_chars, middle_chars, bytes, offsets)."""
    starts = token_starts(data, offs)
    of_doc = np.searchsorted(starts, offs)
    n = np.diff(of_doc)
    low = np.minimum(draws[:, 0] % (n + 1), draws[:, 1] % (n + 1))
    high = np.maximum(draws[:, 0] % (n + 1), draws[:, 1] % (n + 1))
    form = np.where(draws[:, 3] % 100 < spm, SPM_FORM, PSM)
    form[(n == 0) | ~drawn | (draws[:, 2] % 100 >= rate)] = PLAIN
    form[marks_in(data, offs)[0]] = PLAIN

    # byte positions of the cuts; the end of a text stands for the cut behind its last token
    place = np.append(starts, len(data))
    begin, end = offs[:-1], offs[1:]
    cut1 = np.where(low == n, end, place[of_doc[:-1] + np.minimum(low, np.maximum(n - 1, 0))])
    cut2 = np.where(high == n, end, place[of_doc[:-1] + np.minimum(high, np.maximum(n - 1, 0))])
    moved = form != PLAIN
    p, m, s = cut1 - begin, cut2 - cut1, end - cut2
    mark = len(MARKS[0])
    out = np.concatenate([[0], np.cumsum(end - begin + 3 * mark * moved)])
    base = out[:-1]
    # where each part goes in the output, by form
    first = np.where(moved, base + mark, base)
    to_p = np.where(form == SPM_FORM, first + s + mark, first)
    to_s = np.where(form == SPM_FORM, first, first + p + mark)
    to_m = base + p + s + 3 * mark
    to_s, to_m = np.where(moved, to_s, base + cut2 - begin), np.where(moved, to_m, base + p)

    result = np.zeros(int(out[-1]), np.uint8)
    pieces = np.stack([begin, cut1, cut2], 1).ravel()
    shifts = np.stack([to_p - begin, to_m - cut1, to_s - cut2], 1).ravel()
    for a, d in displacements(len(data), *_changes(pieces, shifts)):
        result[np.arange(a, a + len(d)) + d] = data[a:a + len(d)]
    heads = {0: to_p, 1: to_s, 2: to_m}
    for k, text in enumerate(MARKS):
        for j, c in enumerate(text):
            result[heads[k][moved] - mark + j] = c
    chars = np.concatenate([[0], np.cumsum(_LEAD[data])])
    return n, form, chars[cut1] - chars[begin], chars[cut2] - chars[cut1], result, out


def gathered(data: np.ndarray, offs: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that the outputs of a block were made from: (bytes, offsets)."""
    moved = form != PLAIN
    doc, at, which = marks_in(data, offs)
    keep = moved[doc]
    doc, at, which = doc[keep], at[keep], which[keep]
    place = np.zeros((len(form), 3), np.int64)
    place[doc, which] = at
    mark = len(MARKS[0])
    begin, end = offs[:-1], offs[1:]
    out = np.concatenate([[0], np.cumsum(end - begin - 3 * mark * moved)])
    base = out[:-1]
    p_at, s_at, m_at = (place[:, k] + mark for k in range(3))
    spm = form == SPM_FORM
    p = np.where(spm, place[:, 2], place[:, 1]) - p_at
    s = np.where(spm, place[:, 0], place[:, 2]) - s_at
    m = end - m_at
    # pieces of the restored block, in order: prefix, middle, suffix; a plain text is one piece
    p, m, s = (np.where(moved, x, y) for x, y in ((p, end - begin), (m, 0), (s, 0)))
    sources = np.stack([np.where(moved, p_at, begin), m_at, s_at], 1)
    starts = np.stack([base, base + p, base + p + m], 1)
    sources[~moved, 1:] = starts[~moved, 1:]
    result = np.zeros(int(out[-1]), np.uint8)
    for a, d in displacements(len(result), *_changes(starts.ravel(), (sources - starts).ravel())):
        result[a:a + len(d)] = data[np.arange(a, a + len(d)) + d]
    return result, out


def _strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data))


def fill_in_middle(docs: DataFrame, columns: list[str] | None = None, seed: str = "1", rate: int = RATE, spm: int = SPM,
                   text: str = "text") -> DataFrame:
    """``columns`` (default doc_id) with n, form, prefix_chars, middle_chars (code
    points, null if plain) and output, the text as a model is given it."""
    columns = columns or ["doc_id"]
    if set(columns) & set(RESULT):
        raise ValueError(f"names of the result: {sorted(set(columns) & set(RESULT))}")
    kinds = dict(docs.dtypes)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    draws = F.transform(F.array(*[F.lit(k) for k in range(4)]),
                        lambda k: F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    rows = docs.select(*columns, F.col(text).alias("__text"), draws.alias("__draws"), F.col("doc_id").isNotNull().alias("__drawn"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + "".join(f", {c} {k}" for c, k in RESULT.items())

    def run(batches):
        for batch in batches:
            drawn = batch.column("__drawn").to_numpy(zero_copy_only=False)
            h = pa.compute.fill_null(batch.column("__draws").flatten(), 0).to_numpy(zero_copy_only=False).reshape(-1, 4)
            for i, j, data, offs in B.blocks(batch.column("__text"), BLOCK_BYTES):
                n, form, prefix, middle, out, ends = arrange(data, offs, h[i:j], drawn[i:j], rate, spm)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in columns]
                    + [pa.array(n), pa.array(FORMS[form].tolist(), pa.string()), pa.array(prefix, mask=plain),
                       pa.array(middle, mask=plain), _strings(out, ends).cast(pa.string())], names=[*columns, *RESULT])

    return rows.mapInArrow(run, schema)


def restore(made: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of a result of ``fill_in_middle`` with restored, the text
    rebuilt from output and form alone."""
    kinds = dict(made.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", restored string"
    number = F.array_position(F.array(*[F.lit(str(x)) for x in FORMS]), F.col("form")).cast("int") - 1

    def run(batches):
        for batch in batches:
            form = batch.column("__form").to_numpy(zero_copy_only=False)
            for i, j, data, offs in B.blocks(batch.column("__output"), BLOCK_BYTES):
                back, ends = gathered(data, offs, form[i:j])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in columns), _strings(back, ends).cast(pa.string())],
                                                 names=[*columns, "restored"])

    return made.select(*columns, number.alias("__form"), F.col("output").alias("__output")).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document: tokens, form, sizes of the parts, hashes of the output and of
    the text rebuilt from it."""
    made = fill_in_middle(docs).withColumn("output_sha256", F.sha2("output", 256))
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restore(made, kept).select(*kept, F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || doc_id) AS x
  FROM documents),
drawn AS (
  SELECT *, len(w) AS n,
         ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
         ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4
  FROM base),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR doc_id IS NULL OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s
  FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
