"""Streams with keyed state: the first of equal pairs over all rounds, and running progress.

State lives in Spark's state store (RocksDB) and is part of the stream's checkpoint, so a
query that is started again goes on where it was. A key may be given a time to live.
Rows are combined in their task before they are dealt by key: of a pair with very many
copies, or a source with a third of all rows, the key's task gets a row for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siltstone.functions.text import pair_key

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class First(StatefulProcessor):
    """Keeps the least id of a key; passes a row on when it changes."""

    def __init__(self, kind: str, ttl_ms: int | None):
        self.kind, self.ttl_ms = kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", f"id {self.kind}", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.least.get()[0] if self.least.exists() else None
        new = min(batch["id"].min() for batch in rows)
        if had is None or new < had:
            self.least.update((new,))
            yield pd.DataFrame({"pair_key": [key[0]], "id": [new], "replaces": pd.Series([had], dtype=object)})

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """Keeps how many scores a key has, and their sum; passes both on when they change."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, total double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.sums.get() if self.sums.exists() else (0, 0.0)
        for batch in rows:
            n, total = n + int(batch["n"].sum()), total + float(batch["total"].sum())
        self.sums.update((n, total))
        yield pd.DataFrame({"every": [key[0]], "n": [n], "average": [total / n if n else 0.0]})

    def close(self) -> None:
        pass


def first_pairs(examples: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(pair_key, id, replaces) of a stream of (id, user, assistant): a row whenever an
    equal pair with a lesser id comes than any before; ``replaces`` is the one before.

    All rows of all triggers count, in whatever order they come. With ``ttl_ms`` a pair
    that isn't met for so long is forgotten. :func:`settled` gives the outcome.
    """
    kind = dict(examples.dtypes)["id"]

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("pair_key", as_index=False)["id"].min()[["pair_key", "id"]]

    keyed = examples.where(F.col("id").isNotNull()).select(pair_key(F.col("user"), F.col("assistant")).alias("pair_key"), "id")
    combined = keyed.mapInPandas(least, f"pair_key string, id {kind}")
    return combined.groupBy("pair_key").transformWithStateInPandas(First(kind, ttl_ms), f"pair_key string, id {kind}, replaces {kind}", "Append", "ProcessingTime" if ttl_ms else "None")


def settled(changes: DataFrame) -> DataFrame:
    """(pair_key, id): the first row of each pair, from what :func:`first_pairs` has written."""
    return changes.groupBy("pair_key").agg(F.min("id").alias("id"))


def progress(scores: DataFrame, every: str, value: str = "quality_score", ttl_ms: int | None = None) -> DataFrame:
    """(every, n, average) of a stream of scores: for each key of a trigger, how many scores
    it has had so far and their average. Rows without a key are one key; those without a
    score don't count. :func:`latest` gives the outcome."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = batch.groupby("every")["value"].agg(["count", "sum"]).reset_index()
            sums.columns = ["every", "n", "total"]
            yield sums

    rows = scores.select(F.coalesce(F.col(every).cast("string"), F.lit("")).alias("every"), F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull())
    combined = rows.mapInPandas(summed, "every string, n long, total double")
    return combined.groupBy("every").transformWithStateInPandas(Progress(ttl_ms), "every string, n long, average double", "Append", "ProcessingTime" if ttl_ms else "None")


def latest(reports: DataFrame) -> DataFrame:
    """(every, n, average) after the last trigger, from what :func:`progress` has written."""
    return reports.groupBy("every").agg(F.max("n").alias("n"), F.max_by("average", "n").alias("average"))


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Works off what has arrived and appends to the files in ``out``, each row once, also
    if the query is started again after a failure."""
    spark: SparkSession = stream.sparkSession
    # a time to live would ask for rounds without rows for ever
    wanted = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
