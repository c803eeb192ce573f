"""An inverted-file index of vectors on shared files, with exact search.

Centroids are fitted to a bounded sample; every row goes into the list of its nearest
centroid, in blocks of bounded size, written by list. A list keeps how far its rows
are from its centroid at most, and the length of its longest row. By the triangle inequality that
bounds what any of its rows can score, so a search reads a query's nearest lists, and
then those others that might still hold one of its k best: the result is exact, however
the sample came out; only the share of lists that is read depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.plans.sizes import stored
from siltstone.sources.versions import Versions

FORMAT = 1
SAMPLE = 20_000  # rows by hash to which centroids are fitted
LISTS = 1024  # at most
ROUNDS = 12  # of fitting
BLOCK = 2048  # rows
PROBED = 2  # lists that a query reads first
SLACK = 1e-6  # of scores, for rounding


def fitted(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids of a sample by k-means; those that lose all rows start anew."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = np.argmin((centroids * centroids).sum(1)[None, :] - 2 * sample @ centroids.T, axis=1)
        count = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], sample[rng.choice(len(sample), lists)])
    return centroids


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()], np.float64).reshape(-1, dims)


def build(items: DataFrame, path: str, key: str = "item_index", lists: int | None = None, sample: int = SAMPLE, block: int = BLOCK, meta: dict | None = None) -> None:
    """Writes the index of (key, embedding) under ``path``: a new version of it, if there is
    one. Rows without a vector aren't searched. ``lists`` is the root of the rows
    otherwise, LISTS at most.

    The driver holds ``sample`` vectors and the centroids; all else is Spark's.
    """
    spark = items.sparkSession
    rows = stored(items.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col("embedding").cast("array<double>").alias("embedding")))
    n = rows.count()
    taken = rows.orderBy(F.xxhash64("item"), "item").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    dims = len(taken[0]) if n else 0
    taken = vectors_of(taken, dims) if n else np.zeros((0, 0))
    k = min(lists or min(LISTS, int(n**0.5) + 1), len(taken))
    centroids = fitted(taken, k) if n else taken
    shared = spark.sparkContext.broadcast(centroids)
    kind = dict(rows.dtypes)["item"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not len(batch):
                continue
            v = vectors_of(batch["embedding"], dims)
            own = (v * v).sum(1)
            far = own[:, None] + (c * c).sum(1)[None, :] - 2 * v @ c.T
            near = far.argmin(1)
            distance = np.linalg.norm(v - c[near], axis=1)
            yield pa.RecordBatch.from_arrays([batch["item"], batch["embedding"], pa.array(near.astype(np.int32)), pa.array(distance), pa.array(own)], names=["item", "embedding", "list", "distance", "squared"])

    placed = stored(rows.mapInArrow(assigned, f"item {kind}, embedding array<double>, list int, distance double, squared double"))
    sizes = stored(placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max("squared").alias("longest")))
    # a list that holds a third of all rows is in many blocks
    blocks = placed.join(F.broadcast(sizes.select("list", F.ceil(F.col("n") / block).alias("parts"))), "list")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("item"), F.col("parts")))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        v = vectors_of(rows["embedding"].chunk(0), dims)
        ids = pa.ListArray.from_arrays([0, len(rows)], rows["item"].chunk(0))
        return pa.table({"list": rows["list"][:1], "block": rows["block"][:1], "ids": ids, "vectors": pa.array([v.tobytes()], pa.binary())})

    whole = blocks.groupBy("list", "block").applyInArrow(packed, f"list int, block long, ids array<{kind}>, vectors binary")
    where = Versions(spark, path)
    heads = [(int(r["list"]), r["n"], r["radius"], r["longest"], centroids[r["list"]].tolist()) for r in sizes.orderBy("list").collect()]  # LISTS at most
    about = {**(meta or {}), "format": FORMAT, "rows": n, "dims": dims, "key": kind, "lists": heads}
    where.replace(whole.repartition("list", "block").sortWithinPartitions("list"), about, ["list"])


def _blocks_of_queries(probes: DataFrame, kind: str, block: int) -> DataFrame:
    """(list, q_ids, q) of (list, id, embedding), ``block`` queries a row at most, about."""
    counts = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))  # a row for each list
    dealt = probes.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
    both = F.collect_list(F.struct("id", "embedding"))
    return dealt.groupBy("list", "part").agg(both.alias("rows")).select("list", F.col("rows.id").alias("q_ids"), F.flatten("rows.embedding").alias("q"))


def search(queries: DataFrame, path: str, k: int = 3, threshold: float | None = None, others: bool = False, probed: int = PROBED, block: int = BLOCK) -> DataFrame:
    """id, item_index, similarity, match_rank of each query's k best items by dot product,
    as :func:`decontamination.vector_top_k` finds them, from the index under ``path``.

    Of equal similarities the higher item comes first. With ``others`` the item of a
    query's own id isn't counted. :func:`lists_read` tells how much was read.
    """
    return _searched(queries, path, k, threshold, others, probed, block)[0]


def lists_read(queries: DataFrame, path: str, k: int = 3, probed: int = PROBED, others: bool = False) -> DataFrame:
    """One row: queries, lists, and the share of all (query, list) pairs that a search reads."""
    _, first, second, lists, n = _searched(queries, path, k, None, others, probed, BLOCK)
    pairs = first.select("id").unionAll(second.select("id")).agg(F.count(F.lit(1)).alias("read"))
    return pairs.select(F.lit(n).alias("queries"), F.lit(lists).alias("lists"), (F.col("read") / F.greatest(F.lit(n * lists), F.lit(1))).alias("share"))


def _searched(queries: DataFrame, path: str, k: int, threshold: float | None, others: bool, probed: int, block: int):
    spark, index = queries.sparkSession, Versions(queries.sparkSession, path)
    about = index.meta
    if about.get("format") != FORMAT:
        raise ValueError(f"no index of this format under {path}")
    kind, item, dims, heads = dict(queries.dtypes)["id"], about["key"], about["dims"], about["lists"]
    q = stored(queries.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding")))
    n, schema = q.count(), f"id {kind}, item_index {item}, similarity double"
    found_none = spark.createDataFrame([], schema + ", match_rank int")
    probe_schema = f"id {kind}, embedding array<double>, list int"
    if not heads or not n:
        none = spark.createDataFrame([], probe_schema)
        return found_none, none, none, len(heads), n
    shared = spark.sparkContext.broadcast({
        "list": np.array([h[0] for h in heads], np.int32), "radius": np.array([h[2] for h in heads]), "longest": np.array([h[3] for h in heads]),
        "centroid": np.array([h[4] for h in heads]),
    })

    def bounds(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query and list the distance of the centroid, and what a row can score at most."""
        c = shared.value["centroid"]
        own = (v * v).sum(1)
        far = np.sqrt(np.maximum(0, own[:, None] + (c * c).sum(1)[None, :] - 2 * v @ c.T))
        least = np.maximum(0, far - shared.value["radius"][None, :] - SLACK)
        return far, (own[:, None] + shared.value["longest"][None, :] - least * least) / 2

    def probes(batch: pa.RecordBatch, rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays([batch["id"].take(rows), batch["embedding"].take(rows), pa.array(shared.value["list"][at])], names=["id", "embedding", "list"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best = np.argsort(bounds(vectors_of(batch["embedding"], dims))[0], axis=1)[:, :probed]
                yield probes(batch, np.repeat(np.arange(len(batch)), best.shape[1]), best.ravel())

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far, most = bounds(vectors_of(batch["embedding"], dims))
                open_ = most >= batch["least"].to_numpy(zero_copy_only=False)[:, None] - SLACK
                np.put_along_axis(open_, np.argsort(far, axis=1)[:, :probed], False, axis=1)  # read before
                rows, at = np.nonzero(open_)
                yield probes(batch, rows, at)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, names = batch["q_ids"][i].values, batch["ids"][i].values
                b = np.frombuffer(batch["vectors"][i].as_buffer(), np.float64).reshape(-1, dims)
                v = np.asarray(batch["q"][i].values.to_numpy(), np.float64).reshape(-1, dims)
                items = names.to_numpy(zero_copy_only=False)
                order = np.argsort(items, kind="stable")[::-1]  # of equals the higher item first
                scores = v @ b[order].T
                if others:
                    scores[ids.to_numpy(zero_copy_only=False)[:, None] == items[order][None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(ids)), best.shape[1])
                found = scores[rows, best.ravel()]
                kept = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[kept])), names.take(pa.array(order[best.ravel()[kept]])), pa.array(found[kept])], names=["id", "item_index", "similarity"])

    blocks = index.read()
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), F.desc("item_index")))

    def best(asked: DataFrame) -> DataFrame:
        lists = [r["list"] for r in asked.select("list").distinct().collect()]  # LISTS at most: the others' files aren't read
        met = _blocks_of_queries(asked, kind, block).join(blocks.where(F.col("list").isin(lists)), "list")
        return met.select("q_ids", "q", "ids", "vectors").mapInArrow(multiplied, schema)

    first = stored(q.mapInArrow(nearest, probe_schema))
    some = stored(best(first).withColumn("match_rank", rank).where(F.col("match_rank") <= k).drop("match_rank"))
    # what the k-th best has so far; less than k items: nothing is ruled out
    least = some.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
    bounded = q.join(least, "id", "left").select("id", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    second = stored(bounded.mapInArrow(remaining, probe_schema))
    ranked = some.union(best(second)).withColumn("match_rank", rank).where(F.col("match_rank") <= k)
    return ranked if threshold is None else ranked.where(F.col("similarity") >= threshold), first, second, len(heads), n
