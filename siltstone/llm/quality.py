"""Quality classifier: a factorisation machine over words, structure and metadata.

Features are hashed words (the logarithm of their counts, scaled to unit length),
statistics of the text's structure, and metadata (the declared length). Each feature
has a weight and a short vector; a score adds to the weights the products of all
pairs of vectors, in linear time: half of (the square of the sum less the sum of
squares). Training runs on a bounded sample of labelled documents; scoring in Arrow
batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table

TRAIN_ROWS = 4000  # expected bound of the training sample
WORDS = 1 << 12
FACTORS = 8
STEPS = 1500
BATCH = 128
RATE = 0.05
DECAY = 1e-4
SEED = 42
THRESHOLD = 0.7
CACHE = 200_000  # words that a task remembers
CHUNK = 256  # documents whose features are held at once

SYMBOLS = re.compile(r"[^\w\s.,;:'\"()-]")
STATS = (
    "words", "word_length", "distinct", "repeats", "upper", "digits", "symbols", "symbol_words",
    "bars", "exclaims", "stops", "lines", "line_length", "line_repeats", "declared_length",
)


class Model(NamedTuple):
    mean: np.ndarray
    deviation: np.ndarray
    bias: float
    weights: np.ndarray  # (WORDS + STATS,)
    factors: np.ndarray  # (WORDS + STATS, FACTORS)


class Buckets(dict):
    """word -> bucket, filled as words come; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = out = crc32(word.encode()) % WORDS
        return out


def features(text: str, declared: int | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of a whole text's words, their values, and the statistics."""
    words = text.split()
    n = max(1, len(words))
    length = max(1, len(text))
    ids = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    counts = np.bincount(ids, minlength=WORDS)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at])
    values = values / max(np.sqrt((values * values).sum()), 1e-9)
    lines = text.split("\n")
    odd = SYMBOLS.findall(text)
    stats = np.array([
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(set(words)) / n ** 0.8,
        float((ids[1:] == ids[:-1]).sum()) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, "0123456789")) / length,
        len(odd) / length,
        len(odd) / n,
        text.count("|") / n,
        text.count("!") / n,
        text.count(".") / n,
        np.log1p(len(lines)),
        length / len(lines) / 100,
        1 - len(set(lines)) / len(lines),
        np.log1p(max(0, length if declared is None else declared)) - np.log1p(length),
    ])
    return at, values, stats


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    buckets = Buckets()
    for b in batches:
        yield b, [features(t.as_py() or "", n.as_py(), buckets) for t, n in zip(b["text"], b["n_chars"])]


def scores_of(model: Model, texts: pa.Array, declared: pa.Array, buckets: Buckets) -> pa.Array:
    """Scores of a batch, whose features are held for a chunk at a time."""
    out = []
    for start in range(0, len(texts), CHUNK):
        part = zip(texts[start : start + CHUNK], declared[start : start + CHUNK])
        out.append(scored(model, [features(t.as_py() or "", n.as_py(), buckets) for t, n in part]))
    return pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())


def inputs(docs: DataFrame, *more: str) -> DataFrame:
    declared = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), declared.alias("n_chars"), *more)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def scored(model: Model, rows: list) -> np.ndarray:
    """Probabilities of label 1; linear in the features thanks to the sum of squares."""
    if not rows:
        return np.zeros(0)
    stats = np.clip((np.array([r[2] for r in rows]) - model.mean) / model.deviation, -5, 5) / 4
    ids = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    w, v = model.weights, model.factors
    linear = np.bincount(owner, weights=w[ids] * values, minlength=len(rows)) + stats @ w[WORDS:]
    scaled = v[ids] * values[:, None]
    sums = np.stack([np.bincount(owner, weights=scaled[:, f], minlength=len(rows)) for f in range(v.shape[1])], axis=1) + stats @ v[WORDS:]
    squares = np.bincount(owner, weights=(scaled * scaled).sum(axis=1), minlength=len(rows)) + (stats * stats) @ (v[WORDS:] ** 2).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(model.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), -30, 30)))


def fit(rows: list, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model:
    """Adagrad on the logistic loss, ``steps`` batches in whole epochs. With no label, or one kind of label only, the
    model scores every text by the share of ones (one half without labels)."""
    size = WORDS + len(STATS)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), bias, np.zeros(size), np.zeros((size, FACTORS)))
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows])
    mean, deviation = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    dense = np.clip((stats - mean) / deviation, -5, 5) / 4
    w, v, bias = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    wide = np.arange(WORDS, size)
    for _ in range(-(-steps * BATCH // len(rows))):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            part = order[start : start + BATCH]
            ids = np.concatenate([np.concatenate((rows[i][0], wide)) for i in part])
            x = np.concatenate([np.concatenate((rows[i][1], dense[i])) for i in part])
            sizes = np.array([len(rows[i][0]) + len(wide) for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            edges = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            scaled = v[ids] * x[:, None]
            sums = np.add.reduceat(scaled, edges)
            z = bias + np.add.reduceat(w[ids] * x, edges) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((scaled * scaled).sum(axis=1), edges))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            e = error[owner] * x
            dw = np.bincount(ids, weights=e, minlength=size) + DECAY * w
            pull = e[:, None] * (sums[owner] - scaled)
            dv = np.stack([np.bincount(ids, weights=pull[:, f], minlength=size) for f in range(FACTORS)], axis=1) + DECAY * v
            gw += dw * dw
            gv += dv * dv
            gb += error.sum() ** 2
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
            bias -= RATE * error.sum() / np.sqrt(gb)
    return Model(mean, deviation, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from the labelled documents that aren't held out, on a bounded sample.

    ``labels`` has doc_id and quality (0 or 1, null rows aside); of a document's
    several labels the least counts. The sample is chosen among the labels by a hash
    of the id, so that the texts of about ``rows`` documents at most are read for
    it; their features go to the driver.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = rows / max(rows, usable.count())
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    own = inputs(docs).join(F.broadcast(chosen), "doc_id")  # about ``rows`` rows, whatever the input

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in rows_of(batches):
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.string()), pa.array([r[0] for r in found], pa.list_(pa.int64())), pa.array([r[1] for r in found], pa.list_(pa.float64())), pa.array([r[2] for r in found], pa.list_(pa.float64())), b["quality"].cast(pa.float64())],
                names=["doc_id", "ids", "vals", "stats", "quality"],
            )

    table_ = own.select("doc_id", "text", "n_chars", "quality").mapInArrow(of_batches, "doc_id string, ids array<long>, vals array<double>, stats array<double>, quality double").toPandas()
    table_ = table_.sort_values(["doc_id"], kind="stable")
    found = [(np.asarray(a), np.asarray(b), np.asarray(c)) for a, b, c in zip(table_["ids"], table_["vals"], table_["stats"])]
    return fit(found, table_["quality"].to_numpy(dtype=float))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``.

    A null text counts as empty, and is scored; of a very long one every word counts;
    without a column n_chars, or where it
    is null, the declared length is the real one. Repeated rows get equal scores; an
    empty table gives an empty result; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], scores_of(shared.value, b["text"], b["n_chars"], buckets)], names=["doc_id", "score"])

    return inputs(docs).mapInArrow(of_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold (ties pass).

    Null, empty, very long and repeated texts are scored as in :func:`scores`; an empty
    table gives an empty result; columns of any name are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        buckets = Buckets()
        for texts, declared in batches:
            yield scores_of(shared.value, texts, declared, buckets)

    declared = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.where(score(F.col("text").cast("string"), declared) >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``documents``, by a model of the
    labels that aren't held out. Null, empty, very long and repeated texts as in
    :func:`scores`; a null doc_id has a null held_out, and no label to learn from."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    score = F.col("score")
    return scores(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (score >= THRESHOLD).cast("int").alias("predicted"))
