"""Leader clustering in rounds, with the outcome of the sequential pass.

The pass takes rows in order; a row joins the most alike of the leaders that are near
enough, or else leads a new cluster. Leaders don't move, so they are the greedy maximal
independent set of the similarity graph in that order. A round takes the first open
rows, a bounded block, in which the pass is run; what is near its new leaders follows
them and is open no more. No graph is made: a group of copies, however large, is
settled by its first row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ranges import numbered
from siltstone.operators.vector_index import vectors_of
from siltstone.plans.sizes import stored

BLOCK = 2048  # rows of a round's block, and leaders that rows are compared with at once


def first_leaders(v: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each of a block's vectors leads, in their order."""
    near, leads = v @ v.T >= threshold, np.zeros(len(v), bool)
    for i in range(len(v)):
        leads[i] = not (near[i, :i] & leads[:i]).any()
    return leads


def leaders(placed: DataFrame, threshold: float, block: int = BLOCK) -> list[DataFrame]:
    """Tables of (place, embedding) of the leaders of (place, embedding), in rounds.

    The driver holds a block's vectors. There are as many rounds as blocks of leaders,
    or fewer: every round settles a block, and all that follows its leaders.
    """
    open_, out, spark = placed.select("place", "embedding"), [], placed.sparkSession
    while True:
        head = open_.orderBy("place").limit(block).toArrow().combine_chunks()
        if not len(head):
            return out
        own, vectors = head["place"].to_numpy(), head["embedding"].combine_chunks()
        v = vectors_of(vectors, len(vectors[0]))
        led = first_leaders(v, threshold)
        out.append(spark.createDataFrame(head.filter(pa.array(led)).cast(pa.schema([("place", pa.int64()), ("embedding", pa.list_(pa.float64()))]))))
        shared = spark.sparkContext.broadcast((v[led], own.max()))

        def still_open(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ahead, last = shared.value
            for batch in batches:
                if len(batch):
                    far = (vectors_of(batch["embedding"], ahead.shape[1]) @ ahead.T < threshold).all(axis=1)
                    yield batch.filter(pa.array(far & (batch["place"].to_numpy() > last)))

        open_ = stored(open_.mapInArrow(still_open, "place long, embedding array<double>"))


def leader_clusters(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """id, leader_id, semantic_cluster (the leader's number, from 0) and similarity for
    (id, embedding), in the order of ids, which don't repeat.

    Of leaders that are equally alike the first counts. Rows without a vector are in no
    cluster.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    placed = stored(numbered(rows, "id"))
    found = leaders(placed, threshold, block)
    best = None
    for part in found:  # a block of leaders at a time
        table = part.toArrow().combine_chunks()
        own = table["embedding"].combine_chunks() if len(table) else None
        shared = placed.sparkSession.sparkContext.broadcast((table["place"].to_numpy(), vectors_of(own, len(own[0])) if len(table) else np.zeros((0, 0))))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            places, ahead = shared.value
            for batch in batches:
                if len(batch):
                    own = batch["place"].to_numpy()
                    scores = vectors_of(batch["embedding"], ahead.shape[1]) @ ahead.T
                    scores[own[:, None] < places[None, :]] = -np.inf
                    scores[own[:, None] == places[None, :]] = np.inf  # a leader is its own
                    first = scores.argmax(axis=1)
                    score = scores[np.arange(len(own)), first]
                    kept = score >= threshold
                    yield pa.RecordBatch.from_arrays([pa.array(own[kept]), pa.array(places[first[kept]]), pa.array(score[kept])], names=["place", "leader", "score"])

        met = placed.select("place", "embedding").mapInArrow(nearest, "place long, leader long, score double")
        best = met if best is None else best.union(met)
    if best is None:
        return placed.select("id", F.lit(None).cast(dict(vectors.dtypes)["id"]).alias("leader_id"), F.lit(0).cast("long").alias("semantic_cluster"), F.lit(1.0).alias("similarity"))
    one = best.groupBy("place").agg(F.max(F.struct("score", (-F.col("leader")).alias("first"))).alias("m")).select("place", (-F.col("m.first")).alias("leader"), "m.score")
    chosen = stored(placed.select("place", "id").join(one, "place"))
    heads = stored(numbered(chosen.where("place = leader").select("leader", F.col("id").alias("leader_id")), "leader", name="number"))
    out = chosen.join(heads.select("leader", "leader_id", (F.col("number") - 1).alias("semantic_cluster")), "leader")
    return out.select("id", "leader_id", "semantic_cluster", F.when(F.col("place") == F.col("leader"), 1.0).otherwise(F.col("score")).alias("similarity"))
