"""Exact dedup by an extendible-hash index on shared files.

A text's key is a 64-bit hash of its white-space-normalised form. The directory maps
the first bits of keys to buckets. It doubles until no bucket is overfull: an overfull
bucket is split on the next bit, others keep the depth they have, so a bucket is a
range of keys. Its size is that of the corpus's keys over ``CAPACITY``; it is a table,
made and looked up by Spark, and no depth below the key's 64 bits ends it.

Rows are posted to shared files as (key, digest, id), without their texts. A key that
one row has is an entry as it is. Texts are only read again for keys that several rows
have: copies are combined by SALTS, then each bucket's owner task gets what is left
of its range, sorts it, compares bytes, and chains the different texts of a key. Every
row then looks up its entry in the index.

Which rows read their texts again is told by a bitmap: a key whose bit is set may
repeat. It has 16 bits a repeated key, and FILTER_BITS (128 MB) at most, however large
the corpus; where bits collide, texts travel that needn't, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, checkpointed, small, table, text_of

CAPACITY = 4096  # entries of a bucket
KEY_BITS = 64
SALTS = 8  # rows of a text at most that reach its owner task
FILTER_BITS = 1 << 30  # of the bitmap, at most
BITMAP_BITS = 1 << 15  # of one row of it, as Spark's bitmap functions have them


def normalised(docs: DataFrame) -> Column:
    return F.regexp_replace(text_of(docs), SPACE + "+", " ")


def first_bits(key: Column, bits: int) -> Column:
    """The key's first bits as a number; 0 if there are none."""
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, bits) for each slot that has keys, and the directory's depth.

    ``keys`` (key, distinct) is checkpointed. A slot is a number of as many first bits
    as the directory is deep; a bucket is the least slot of those that share its bits.
    Depth begins where buckets would be half full on average, and doubling goes on
    until none is overfull: the slots' counts are summed by Spark.
    """
    n = keys.count()
    depth = max(0, (max(n, 1) * 2 // max(capacity, 1)).bit_length() - 1)
    while True:
        slots = checkpointed(keys.groupBy(first_bits(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
        if depth >= KEY_BITS - 1 or (slots.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth += 1
    # of the depths at which a slot's prefix isn't overfull, the least is its bucket's
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    prefix = F.expr(f"shiftrightunsigned(slot, {depth} - bits)")
    held = F.sum("n").over(Window.partitionBy("bits", "prefix"))
    fits = levels.withColumn("prefix", prefix).withColumn("held", held).where((F.col("held") <= capacity) | (F.col("bits") == depth))
    leaf = fits.groupBy("slot").agg(F.min("bits").alias("bits"))
    return leaf.select("slot", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - bits), {depth} - bits)").alias("bucket"), "bits"), depth


def filter_size(repeated: int, most: int = FILTER_BITS) -> int:
    """Bits of the bitmap for so many repeated keys."""
    return min(most, BITMAP_BITS << max(0, (16 * repeated // BITMAP_BITS).bit_length()))


def bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """(part, bitmap) of the keys' places among ``bits`` bits: at most bits / BITMAP_BITS rows."""
    place = F.pmod("key", F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def is_set(bits_of_part: Column, key: Column, bits: int) -> Column:
    at = F.bitmap_bit_position(F.pmod(key, F.lit(bits)))
    byte = F.conv(F.hex(F.substring(bits_of_part, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1


def posted(docs: DataFrame, key: Callable = F.xxhash64) -> DataFrame:
    """doc_id, key, text_sha256 of each row, on shared files."""
    body = docs.select(F.col("doc_id"), normalised(docs).alias("body"))
    return checkpointed(body.select("doc_id", key("body").alias("key"), F.sha2("body", 256).alias("text_sha256")))


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY, key: Callable = F.xxhash64, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The index, on shared files: bucket, key, chain, text_sha256, keep_id, group_size.

    ``rows`` are the :func:`posted` ones of ``docs``. ``chain`` is the entry's place
    among the different texts of its key. ``key`` may be any function of the text to a
    long (tests pass one that collides).
    """
    least, size, digest = F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("text_sha256").alias("text_sha256")
    keys = checkpointed(rows.groupBy("key").agg(least, size, digest))
    slots, depth = directory(keys, capacity)
    slots = small(checkpointed(slots)).select("slot", "bucket")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("slot", first_bits(F.col("key"), depth)).join(slots, "slot").drop("slot")

    single = placed(keys.where("group_size = 1")).withColumn("chain", F.lit(1))

    several = keys.where("group_size > 1").select("key")
    bits = filter_size(several.count(), filter_bits)
    repeated = F.broadcast(bitmap(several, bits))  # bits / 8 bytes
    body = docs.select("doc_id", normalised(docs).alias("body")).withColumn("key", key("body"))
    part = F.bitmap_bucket_number(F.pmod("key", F.lit(bits)))
    again = body.join(repeated, part == repeated["part"]).where(is_set(F.col("bitmap"), F.col("key"), bits)).select("doc_id", "key", "body")
    # a text with many copies reaches its owner as few rows; each has what one salt saw
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    combined = again.groupBy("key", "body", salt.alias("salt")).agg(least, size)
    owned = placed(combined).repartition("bucket")
    chain = F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("body"))  # the owner compares bytes
    entries = (
        owned.withColumn("chain", chain)
        .withColumn("text_sha256", F.sha2("body", 256))
        .groupBy("bucket", "key", "chain")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), digest)
    )
    columns = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size"]
    chained = entries.join(several.hint("merge"), "key", "left_semi")  # without keys whose bits collide
    return checkpointed(single.select(*columns).union(chained.select(*columns)))


def find_copies(docs: DataFrame, capacity: int = CAPACITY, key: Callable = F.xxhash64, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, key.

    A null text counts as empty; whole texts are compared, however long. Of equal
    texts the smallest doc_id is kept; a null doc_id is kept only if all of its group
    are null. Rows that repeat both text and doc_id tie: they are all kept, or none of
    them is (the pipeline keeps one of them). An empty table gives an empty result;
    other columns of ``docs``, whatever their names, aren't read.
    """
    rows = posted(docs, key)
    index = build_index(docs, rows, capacity, key, filter_bits).select("key", "text_sha256", "keep_id", "group_size")
    found = rows.join(index.hint("merge"), ["key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "key")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256. Null,
    empty, very long and repeated texts as in :func:`find_copies`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_copies(docs).drop("key")


ORACLE_SQL = r"""
WITH body AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM body WINDOW w AS (PARTITION BY text_sha256)
"""
