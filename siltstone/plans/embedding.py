"""Vectors of texts from a model that is handed in, kept by the texts' contents.

A model is a function without arguments that loads it and returns a function from a
list of texts to an array of vectors; it is loaded once in a worker. A store keeps one
vector for each different text, by its hash, so that a text that was seen in this or
any earlier run isn't embedded again. A store is for one model, one scope (what the texts
are) and one format: with another it is void, and made anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import decontamination as decon
from siltstone.operators import vector_index
from siltstone.plans.sizes import stored
from siltstone.sources.versions import Versions

Model = Callable[[], Callable[[list[str]], np.ndarray]]
FORMAT = 1
BATCH = 256  # texts for which a model is called at once
_LOADED: dict[str, Callable] = {}


def loaded(name: str, model: Model) -> Callable[[list[str]], np.ndarray]:
    """The model of this worker process."""
    if name not in _LOADED:
        _LOADED[name] = model()
    return _LOADED[name]


def letters() -> Callable[[list[str]], np.ndarray]:
    """A stand-in for tests: how often each letter from a to z occurs, at length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        counts = np.array([[t.lower().count(chr(c)) for c in range(97, 123)] for t in texts], np.float64)
        return counts / np.maximum(np.linalg.norm(counts, axis=1), 1e-12)[:, None]

    return embed


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class VectorStore:
    """Vectors by content under a shared ``path``, of the model that ``name`` stands for."""

    def __init__(self, spark: SparkSession, path: str, name: str, model: Model, scope: str = "", prefix: str = ""):
        """``prefix`` is put before each text that is shown to the model, as some ask for
        (another one for what is searched than for what is searched for)."""
        self.spark, self.path, self.name, self.model, self.prefix = spark, path, name, model, prefix
        self.about = {"format": FORMAT, "model": name, "scope": scope, "prefix": prefix}
        self.table = Versions(spark, path)

    def valid(self) -> bool:
        """Whether what is there was made for this model, scope, prefix and format."""
        return self.table.exists() and self.table.meta == self.about

    def _embedded(self, texts: DataFrame) -> DataFrame:
        name, model, prefix = f"{self.name} {self.path}", self.model, self.prefix

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            embed = loaded(name, model)
            for whole in batches:
                for start in range(0, len(whole), BATCH):
                    batch = whole.slice(start, BATCH)
                    vectors = np.asarray(embed([prefix + t for t in batch["text"].to_pylist()]), np.float64)
                    if vectors.shape[0] != len(batch):
                        raise ValueError(f"the model gave {vectors.shape[0]} vectors for {len(batch)} texts")
                    yield pa.RecordBatch.from_arrays([batch["hash"], pa.array(list(vectors), pa.list_(pa.float64()))], names=["hash", "embedding"])

        return texts.mapInArrow(of_batches, "hash string, embedding array<double>")

    def add(self, texts: DataFrame) -> None:
        """Embeds those of ``texts`` (text) that aren't there; each different one once.

        The vectors are written before they are used, so a lost executor costs only
        what its tasks hadn't written. A null text counts as an empty one.
        """
        distinct = texts.select(content_hash(F.col("text")).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
        # copies meet by their hash, not by their text
        distinct = distinct.groupBy("hash").agg(F.any_value("text").alias("text"))
        if self.valid():
            unseen = stored(distinct.join(self.table.read().select("hash"), "hash", "left_anti"))
            if not unseen.isEmpty():
                self.table.append(self._embedded(unseen))
        else:
            self.table.replace(self._embedded(distinct), self.about)

    def vectors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``embedding`` of their text, unseen texts being embedded first."""
        self.add(rows.select("text"))
        known = self.table.read().select(F.col("hash").alias("content hash"), "embedding")
        keyed = rows.withColumn("content hash", content_hash(F.col("text")))
        return keyed.join(known, "content hash").drop("content hash")


def bench_index(store: VectorStore, bench: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """(place, benchmark, item_index) of the items of ``bench`` (benchmark, item_index,
    text), whose vectors are indexed under ``path`` by place.

    The index is made for the store's model and for these very texts; with the same it
    is read again, else it is built anew.
    """
    texts = bench.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("item_index", "text").cast("decimal(38,0)")).alias("x"))
    about = {**store.about, "limit": limit, "texts": sorted([r["benchmark"], r["n"], str(r["x"])] for r in texts.collect())}  # a row for each benchmark
    names = Versions(store.spark, f"{path}/names")
    if not (names.exists() and names.meta == about):
        named = store.vectors(bench.select("benchmark", "item_index", "text"))
        named = stored(named.select(F.xxhash64("benchmark", "item_index").alias("place"), "benchmark", "item_index", "embedding"))
        vector_index.build(named, f"{path}/vectors", "place")
        names.replace(named.drop("embedding"), about)
    return names.read()


def text_evidence(examples: DataFrame, bench: DataFrame, store: VectorStore, path: str, k: int = decon.TOP_K, threshold: float = decon.THRESHOLD, queries: VectorStore | None = None) -> DataFrame:
    """Evidence by vectors, as :func:`decon.vector_evidence`, from texts: examples (id, text)
    against the indexed items. ``queries`` embeds the examples, if a model asks for another prefix."""
    names = bench_index(store, bench, path)
    near = vector_index.search((queries or store).vectors(examples.select("id", "text")), f"{path}/vectors", k, threshold)
    named = near.join(names, near["item_index"] == names["place"]).select("id", "benchmark", names["item_index"], "similarity", "match_rank")
    return named.select("id", "benchmark", "item_index", F.lit("embedding").alias("method"), F.round("similarity", 4).alias("confidence"), "match_rank")
