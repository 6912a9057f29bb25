"""Semi-join with a large key set (S3, J5): a Bloom filter of the keys in front of
the shuffle, the exact semi-join behind it.

The filter is an array of bits in longs, built by aggregates (``bit_or`` of the
keys' positions) and read as a scalar subquery, so it is known before the large
side runs and drops its rows in the scan's own stage. Its size is bounded; a key
set beyond it only raises the share of false hits, which the semi-join removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.cleaning import semi_join_keys

HASHES = 4
#: Bits for each key (about 1.2 % false hits) and bits at most (8 MB).
BITS_A_KEY, MOST_BITS = 10, 1 << 26
#: Longs of the filter that are put together in one group.
STRIP = 1 << 12
#: Longs of a strip of a filter that is a table.
WIDTH = 64


def size_of(keys: int, most: int = MOST_BITS) -> int:
    """Bits of a filter for so many keys: a power of two within the bound."""
    return min(most, max(1 << 10, 1 << (BITS_A_KEY * max(1, keys) - 1).bit_length()))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(j)), F.lit(bits)) for j in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, bits: int) -> Column:
    """The filter of the keys: an array of bits / 64 longs, as a scalar subquery."""
    spark = keys.sparkSession
    places = keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("p"))
    words = places.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    whole = spark.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))

    def inorder(place: str, value: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value])

    strips = whole.groupBy(F.expr(f"id div {STRIP}").alias("strip")).agg(inorder("id", "b").alias("b"))
    return strips.agg(F.flatten(inorder("strip", "b"))).scalar()


def might_contain(bloom: Column, key: Column, bits: int) -> Column:
    """Whether the key can be among those of the filter."""
    hit = F.lit(True)
    for p in _positions(key, bits):
        hit = hit & (F.getbit(F.element_at(bloom, (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")) == 1)
    return hit


def strips_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The filter of the keys as a table (strip, b), ``WIDTH`` longs a row; strips without
    keys are left out. For a filter that is large: a value that expressions refer to goes
    into every stage's code once for each reference, on the driver too."""
    one = keys.select(_strip(F.col(key), bits).alias("strip"), F.explode(F.array(*_inside(F.col(key)))).alias("p"))
    words = one.groupBy("strip", F.expr("p div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    held = words.groupBy("strip").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    return held.select("strip", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("b"))


def _strip(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(max(1, bits // (64 * WIDTH)))).alias("strip")


def _inside(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.shiftright(h, 12 * j), F.lit(64 * WIDTH)) for j in range(HASHES)]


def passing(df: DataFrame, key: str, strips: DataFrame, bits: int) -> DataFrame:
    """The rows whose key can be among those of ``strips_of``. The strips are broadcast:
    their size is bounded by ``bits``, and an executor holds them once."""
    hit = F.lit(True)
    for p in _inside(F.col(key)):
        hit = hit & (F.getbit(F.element_at("__b", (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")) == 1)
    rows = df.select("*", _strip(F.col(key), bits).alias("__strip"))
    return rows.join(F.broadcast(strips.toDF("__strip", "__b")), "__strip").where(hit).drop("__strip", "__b")


def filtered(df: DataFrame, keys: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """The rows whose key passes the filter: all that match, and a few more."""
    known = keys.select(key).where(F.col(key).isNotNull()).distinct()
    bits = bits or size_of(known.count())
    return df.where(F.col(key).isNotNull() & might_contain(bloom_filter(known, key, bits), F.col(key), bits))


def semi_join(df: DataFrame, keys: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """The rows whose key is in ``keys``, as ``cleaning.semi_join_keys`` has
    them, with the filter in front. Runs one job, which counts the keys."""
    return semi_join_keys(filtered(df, keys, key, bits), keys, key)
