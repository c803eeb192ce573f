"""A filter of keys that drops rows before a shuffled join: a blocked Bloom filter as a table.

A key sets two bits in one bucket of 32,768; buckets are rows of (part, words), at most
MOST_PARTS of them (128 MB), so that the filter may be broadcast whatever it was made
of. Keys that it doesn't know have no partner; of the others about one in sixty has
none, and one more in step with the keys beyond the bound. The join that follows decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 1 << 15  # bits
BITS_PER_KEY = 16
MOST_PARTS = 1 << 15


def parts_for(keys: int, most: int = MOST_PARTS) -> int:
    """Buckets for so many keys, a power of two."""
    wanted = max(1, -(-keys * BITS_PER_KEY // BUCKET))
    return min(most, 1 << (wanted - 1).bit_length())


def _at(h: Column, shift: int, size: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(size - 1))


def _part(h: Column, parts: int) -> Column:
    return h.bitwiseAND(F.lit(parts - 1)).cast("int")


def key_filter(keys: DataFrame, n: int, most: int = MOST_PARTS) -> DataFrame:
    """(part, words) of about ``n`` keys (h, 64-bit hashes)."""
    parts = parts_for(n, most)
    places = keys.select(_part(F.col("h"), parts).alias("part"), F.explode(F.array(_at(F.col("h"), 15, BUCKET), _at(F.col("h"), 30, BUCKET))).alias("at"))
    bits = places.select("part", (F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    spark = keys.sparkSession
    none = spark.range(parts * (BUCKET // 64)).select((F.col("id") / (BUCKET // 64)).cast("int").alias("part"), (F.col("id") % (BUCKET // 64)).cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = bits.union(none).groupBy("part", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select("part", F.col("w.bits").alias("words"))


def known(rows: DataFrame, h: str, keys: DataFrame, n: int, most: int = MOST_PARTS) -> DataFrame:
    """The ``rows`` whose hash, in column ``h``, a :func:`key_filter` of ``keys`` may know."""
    table = key_filter(keys, n, most).select(F.col("part").alias("part of the filter"), "words")
    joined = rows.join(F.broadcast(table), _part(F.col(h), parts_for(n, most)) == F.col("part of the filter"))  # MOST_PARTS rows of 4 KB

    def is_set(shift: int) -> Column:
        at = _at(F.col(h), shift, BUCKET)
        return F.call_function("getbit", F.element_at("words", (at / 64).cast("int") + 1), (at % 64).cast("int")) == 1

    return joined.where(is_set(15) & is_set(30)).select(*rows.columns)
