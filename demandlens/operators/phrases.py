"""Extraction with a large taxonomy (X1, X2): an index of phrases instead of one
regular expression for each.

A text is cut into words once. At each word, the stretches of the phrases' numbers
of words are looked up in a Bloom filter of the phrases' cores (``keyset``), in the
scan's own stage; what passes is joined by equality with the phrases. So the work
follows the texts, what is shuffled follows their hits, and neither follows the
number of phrases. A stretch goes from a phrase's first word
to its last, separators included, so an equal one is a verified hit; what a phrase
has before its first or after its last word ("C++", ".NET") is compared with the
separators beside the stretch. The rows are those of ``extract.phrase_pattern`` run
for every phrase: case-insensitive, whole phrase.

The phrases are broadcast while they are few enough (``FILED``, counted first);
beyond that the join is by sort-merge, whose hot keys AQE splits. The filter is
bounded (``MOST_BITS``) and broadcast as a table: phrases beyond it only raise the share of false hits, which
the join removes. Long texts are cut into overlapping chunks,
so no array grows with a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.text import NON_WORD, WORD_CHAR, fold
from demandlens.operators import keyset
from demandlens.operators.extract import extract_skills
from demandlens.session import checkpointed

#: Characters of a text that are cut off at once, and of these into words at once.
CHUNK, PIECE = 1 << 17, 1 << 12
#: Phrases that are broadcast at most, and their bytes.
FILED, FILED_BYTES = 500_000, 8 << 20
#: Bits of the filter at most (32 MB).
MOST_BITS = 1 << 28
#: Words of a longer stretch that are looked up first.
HEAD = 3

_WORD = f"{WORD_CHAR}+"


def _cut(text: Column) -> tuple[Column, Column]:
    """(words, separators): separator i stands before word i, the last one after all words."""
    return F.regexp_extract_all(text, F.lit(f"({_WORD})")), F.split(text, _WORD, -1)


def phrase_index(phrases: DataFrame, phrase: str = "skill") -> DataFrame:
    """(core, n, head, before, after, skill) of the distinct phrases that hold a word:
    n counts the words of the core, the head has the first ``HEAD`` ones."""
    folded = phrases.where(F.col(phrase).isNotNull()).select(F.col(phrase).alias("skill")).distinct()
    words, seps = _cut(F.col("_f"))
    cut = folded.withColumn("_f", fold(F.col("skill"))).select("skill", words.alias("w"), seps.alias("s")).where(F.size("w") > 0)
    pieces = F.transform(F.arrays_zip("w", F.slice("s", F.lit(2), F.size("w")).alias("s")), lambda x: F.concat(x["w"], x["s"]))
    inner, after = F.array_join(pieces, ""), F.element_at("s", -1)
    begin, gap = F.array_join(F.slice(pieces, 1, HEAD), ""), F.element_at("s", F.least(F.size("w"), F.lit(HEAD)) + 1)
    return cut.select(F.substring(inner, F.lit(1), F.length(inner) - F.length(after)).alias("core"), F.size("w").alias("n"),
                      F.substring(begin, F.lit(1), F.length(begin) - F.length(gap)).alias("head"), F.element_at("s", 1).alias("before"), after.alias("after"), "skill")


def _stretches(df: DataFrame, size: int, reach: int) -> DataFrame:
    """Rows (..., part, first, last) cut on into stretches of ``size`` characters. A
    stretch begins a character early and ends ``reach`` characters late, so that
    every phrase that begins in it stands in it whole, with its neighbours."""
    others = [c for c in df.columns if c not in ("part", "first", "last")]
    n = F.length("part")
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / size).cast("int")))).alias("_k"))
    begin = F.col("_k") * size
    part = F.when(n <= size, F.col("part")).otherwise(F.substring("part", F.greatest(F.lit(1), begin), F.lit(size + reach + 2)))
    return rows.select(*others, part.alias("part"), ((F.col("_k") == 0) & F.col("first")).alias("first"),
                       ((begin + size + reach + 1 >= n) & F.col("last")).alias("last"))


def _pieces(df: DataFrame, keys: list[str], text: str, reach: int) -> DataFrame:
    """(key, part, first, last): the folded texts in pieces of bounded size."""
    folded = df.where(F.col(text).isNotNull()).select(*keys, fold(F.col(text)).alias("part"), F.lit(True).alias("first"), F.lit(True).alias("last"))
    return _stretches(_stretches(folded, CHUNK, reach), PIECE, reach)


def _grams(pieces: DataFrame, lengths: list[int], keys: list[str], bloom: DataFrame, bits: int) -> DataFrame:
    """(key, core, before, after) of the stretches of the given numbers of words whose
    core passes the filter."""
    # tokens: words and separators by turns; a generator of one row keeps them as a
    # column, as an expression would run again for each use
    rows = pieces.select(*keys, "first", "last", F.explode(F.array(F.regexp_extract_all("part", F.lit(f"({_WORD}|{NON_WORD}+)")))).alias("u"))
    rows = rows.select("*", F.when(F.get("u", F.lit(0)).rlike(f"^{WORD_CHAR}"), 0).otherwise(1).alias("odd"))
    at = rows.select("*", F.posexplode("u").alias("i", "token")).where("i % 2 = odd")
    i, size, end = F.col("i"), F.size("u"), F.col("i") + 2 * F.col("n") - 2
    # a word that the cut of a piece touches may be part of one
    whole = ((i > 0) | F.col("first")) & ((end < size - 1) | ((end == size - 1) & F.col("last")))
    core = F.concat_ws("", F.slice("u", i + 1, 2 * F.col("n") - 1))

    # one row a length, and one a hash: expressions written out for every length, or for
    # every look into the filter, make a method that the JVM leaves uncompiled
    def passing(rows: DataFrame, words: list[int]) -> DataFrame:
        rows = rows.select("*", F.explode(F.lit(words)).alias("n")).where(whole)
        return keyset.passing(rows.select("*", F.explode(F.array(F.xxhash64(core))).alias("h")), "h", bloom, bits).drop("h")

    found = passing(at, sorted({min(n, HEAD) for n in lengths}))
    longer = [n for n in lengths if n > HEAD]
    if longer:  # what begins as a longer phrase does, and what has all of its words
        own = [HEAD] if HEAD in lengths else []
        full = found.select("*", F.explode(F.when(F.col("n") == HEAD, F.lit(own + longer)).otherwise(F.array("n"))).alias("m"))
        full = full.drop("n").withColumnRenamed("m", "n").where(whole)
        found = keyset.passing(full.select("*", F.explode(F.array(F.xxhash64(core))).alias("h")), "h", bloom, bits)
    # the text's edge counts as a character that is none of a word
    before = F.concat(F.when(F.col("first") & (i <= 1), "\n").otherwise(""), F.when(i > 0, F.get("u", i - 1)).otherwise(""))
    after = F.concat(F.coalesce(F.get("u", end + 1), F.lit("")), F.when(F.col("last") & (end + 2 >= size), "\n").otherwise(""))
    return found.select(*keys, core.alias("core"), before.alias("_b"), after.alias("_a"))


def match_phrases(df: DataFrame, text: str, phrases: DataFrame, key: str | list[str], phrase: str = "skill") -> DataFrame:
    """Distinct (key, skill) of the phrases found in each text; null and empty
    texts hold none. Rows of one key count as one."""
    keys = [key] if isinstance(key, str) else list(key)
    index = checkpointed(phrase_index(phrases, phrase))
    # a few numbers about the list, in one small job
    shape = index.agg(F.sort_array(F.collect_set("n")).alias("lengths"), F.max(F.length("skill")).alias("longest"),
                      F.count(F.lit(1)).alias("phrases"), F.sum(F.octet_length("core") + F.octet_length("skill") + 60).alias("bytes")).first()
    bare = [r.skill for r in phrases.where(~F.col(phrase).rlike(WORD_CHAR) & (F.col(phrase) != "")).select(F.col(phrase).alias("skill")).distinct().collect()]
    found = []
    if shape.lengths:
        pieces = _pieces(df, keys, text, shape.longest)
        bits = keyset.size_of(shape.phrases, MOST_BITS)
        listed = index.select(F.explode(F.array_distinct(F.array(F.xxhash64("core"), F.xxhash64("head")))).alias("h"))
        bloom = checkpointed(keyset.strips_of(listed, "h", bits))
        grams = _grams(pieces, shape.lengths, keys, bloom, bits)
        few = shape.phrases <= FILED and shape.bytes <= FILED_BYTES
        listed = index.select("core", "before", "after", "skill")
        # beside a decoration there is the text's edge or one more character, none of a word
        clear = (((F.col("before") == "") | (F.endswith("_b", F.col("before")) & (F.length("_b") > F.length("before"))))
                 & ((F.col("after") == "") | (F.startswith("_a", F.col("after")) & (F.length("_a") > F.length("after")))))
        hits = grams.join(F.broadcast(listed) if few else listed, "core").where(clear)
        found.append(hits.select(*keys, "skill"))
    if bare:  # phrases without a word, such as "++": few by nature
        plain = df.select(*keys, F.explode(extract_skills(F.col(text), bare)).alias("skill"))
        found.append(plain)
    if not found:
        return df.select(*keys, F.lit("").alias("skill")).limit(0)
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return out.distinct()


def attach_found(df: DataFrame, found: DataFrame, key: str, out: str = "skills_found") -> DataFrame:
    """The input with the array of its phrases, longest first, then by name."""
    lists = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.length("skill"), "skill"))), lambda x: x["skill"]).alias(out))
    return df.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
