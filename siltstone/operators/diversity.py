"""Diversity: pairwise gram distance, lexical richness, mean vector distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import grams_diversity, words

SAMPLE = 50
SAMPLE_SEED = 42


def sample(rows: DataFrame, k: int | None = SAMPLE, seed: int | None = SAMPLE_SEED) -> DataFrame:
    """k rows by a hash of the id, or the first k by id without a seed; all if k is None."""
    if k is None:
        return rows
    return rows.orderBy("id" if seed is None else F.xxhash64("id", F.lit(seed)), "id").limit(k)


def embeddable(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Rows whose answer isn't blank, which vector metrics are about; the first ``n`` by id
    if given, the sample that a model is asked for."""
    kept = rows.where(F.trim(F.coalesce("assistant", F.lit(""))) != "")
    return kept if n is None else kept.orderBy("id").limit(n)


def mean_gram_distance(rows: DataFrame, n: int = 3) -> DataFrame:
    """One row, ``diversity``: the mean Jaccard distance of all pairs of (id, assistant).

    Only pairs that share a gram are formed: every other pair is at distance 1, except
    pairs of two texts without grams, which are left out. 1 for fewer than two rows.
    """
    sets = rows.select("id", grams_diversity(F.col("assistant"), n).alias("g")).withColumn("size", F.size("g"))
    each = sets.select("id", "size", F.explode("g").alias("gram"))
    other = each.select(F.col("id").alias("id2"), F.col("size").alias("size2"), "gram")
    shared = each.join(other, "gram").where(F.col("id") < F.col("id2")).groupBy("id", "id2", "size", "size2").agg(F.count(F.lit(1)).alias("both"))
    likeness = shared.agg(F.coalesce(F.sum(F.col("both") / (F.col("size") + F.col("size2") - F.col("both"))), F.lit(0.0)).alias("likeness"))
    counts = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") == 0).alias("e"))
    pairs = (F.col("n") * (F.col("n") - 1) - F.col("e") * (F.col("e") - 1)) / 2
    return counts.join(likeness).select(F.when(pairs > 0, (pairs - F.col("likeness")) / F.greatest(pairs, F.lit(1.0))).otherwise(F.lit(1.0)).alias("diversity"))


FUNCTIONS = 64
PRIME = (1 << 31) - 1


def coefficients(functions: int = FUNCTIONS) -> list[tuple[int, int]]:
    """Multiplier and addend of each hash function x -> (a x + b) mod PRIME, by a rule that
    other engines can follow: powers of a primitive root."""
    return [(pow(7, 2 * i + 1, PRIME), pow(7, 2 * i + 2, PRIME)) for i in range(functions)]


def min_hashes(rows: DataFrame, n: int = 3, functions: int = FUNCTIONS) -> DataFrame:
    """id and least (the least value of each hash function over the text's grams) of (id,
    assistant); rows without grams have null. A gram's number is the first seven
    hexadecimal digits of its MD5."""
    a, b = (np.array(x, np.int64) for x in zip(*coefficients(functions)))
    kind = dict(rows.dtypes)["id"]
    grams = rows.select("id", F.transform(grams_diversity(F.col("assistant"), n), lambda g: F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("long")).alias("x"))

    def least(x: np.ndarray) -> list[int]:
        out = np.full(functions, PRIME, np.int64)
        for at in range(0, len(x), 4096):  # of a long text, a part at a time
            np.minimum(out, ((a[:, None] * x[None, at : at + 4096] + b[:, None]) % PRIME).min(axis=1), out=out)
        return out.tolist()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [least(x.values.to_numpy()) if len(x) else None for x in batch["x"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.list_(pa.int64()))], names=["id", "least"])

    return grams.mapInArrow(of_batches, f"id {kind}, least array<long>")


def estimated_gram_distance(rows: DataFrame, n: int = 3, functions: int = FUNCTIONS) -> DataFrame:
    """One row, ``diversity`` and ``standard_error``: the mean Jaccard distance of all pairs
    of a whole table, estimated in time linear in its rows.

    Two texts have the same least value of a hash function with a probability that is
    their likeness. So the pairs with equal values, counted by value, are for each
    function an estimate of the sum over all pairs; the result is their mean, and the
    error that of the mean. Pairs of two texts without grams are left out, as in
    :func:`mean_gram_distance`, which is exact and for samples.
    """
    hashed = min_hashes(rows, n, functions)
    # a value that very many texts have is counted in tasks first; texts without grams are those without a function's number
    same = hashed.select(F.posexplode_outer("least").alias("i", "v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
    each = same.groupBy("i").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    likeness = F.when(F.col("i").isNotNull(), F.col("pairs"))
    one = each.agg(
        F.coalesce(F.sum(F.when(F.col("i").isNull() | (F.col("i") == 0), F.col("rows"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("rows"))), F.lit(0)).alias("e"),
        F.coalesce(F.avg(likeness), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(likeness), F.lit(0.0)).alias("spread"),
    )
    pairs = (F.col("n") * (F.col("n") - 1) - F.col("e") * (F.col("e") - 1)) / 2
    share = lambda x: x / F.greatest(pairs, F.lit(1.0))
    return one.select(F.when(pairs > 0, 1 - share(F.col("mean"))).otherwise(F.lit(1.0)).alias("diversity"), share(F.col("spread") / functions**0.5).alias("standard_error"))


def lexical_diversity(rows: DataFrame) -> DataFrame:
    """distinct, total: lower-cased words of all answers, and their ratio (0 if none)."""
    counts = rows.select(F.explode(words(F.lower(F.col("assistant")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn(
        "lexical_diversity", F.col("distinct") / F.greatest("total", F.lit(1))
    )


def mean_vector_distance(vectors: DataFrame) -> DataFrame:
    """One row: the mean of 1 - dot over all pairs of (id, embedding), in linear time:
    the pairs' dots sum to half of (the square of the sum less the sum of squares)."""
    parts = vectors.select(F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    sums = parts.groupBy("at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    dots = sums.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("dots"))
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(dots).select(F.when(pairs > 0, 1 - F.col("dots") / F.greatest(pairs, F.lit(1.0))).otherwise(F.lit(1.0)).alias("embedding_diversity"))
