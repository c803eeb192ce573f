"""Spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

All bigrams of the vocabulary are ordered by frequency, the rarest first. One edit
destroys at most two of a word's positional bigrams, so of its three rarest at least
one is left in any word that is one edit away, and it is among the three rarest of
the word whose third is the more frequent. Only those three are joined on.

A bigram that is left lies before the edit or behind it. Before it, it has the same
position from the start, and all that comes before it is the same; and then that holds
for the bigram's first place too. Behind it the same is true of positions from the end
and of its last place. So a word has one key for each side of each of at most three
bigrams: the side, the word up to (or from) the bigram, and a length, its own or
one more. Words that share a key are candidates, which are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
EVERY = 97  # of (document, run) pairs one has a letter deleted
RAREST = 3  # bigrams that are joined on: one more than an edit can destroy
DOMINANT = 2  # times as frequent as a word is its form
FLUSH = 400_000  # different words of a task that are counted before they are passed on
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def altered(doc_id: str, run: str) -> str:
    """The run in lower case, without one letter if the hash of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all runs of letters of whole texts, each word once, of ``least_length``
    code points at least. Runs are counted in a document, then in a task, then in all."""
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                lower = text.lower() if text.isascii() else text.translate(LOWER)
                for run, n in Counter(runs.findall(lower)).items():
                    word = altered(doc_id, run)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > FLUSH:
                    yield passed()
        if total:
            yield passed()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(of_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_order(words: DataFrame) -> dict[str, int]:
    """bigram -> its place in the order by frequency, the rarest first, then by code points.

    Words are of 90 letters at most (a to z, U+00C0 to U+00FF), so the driver gets
    8,100 rows at most, whatever the corpus.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["gram"])))}


def keys_of(word: str, order: dict[str, int], rarest: int = RAREST) -> tuple[list[int], list[int]]:
    """The keys under which a word is met by longer or equal words, and its own."""
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    chosen = sorted(grams, key=order.__getitem__)[:rarest]
    sides = []
    for gram in dict.fromkeys(chosen):
        first, last = grams.index(gram), len(grams) - 1 - grams[::-1].index(gram)
        sides += [f"<{word[: first + 2]}", f">{word[last:]}"]
    key = lambda side, length: xxhash.xxh3_64_intdigest(f"{length}{side}".encode()) - (1 << 63)
    own = [key(s, len(word)) for s in sides]
    return own + [key(s, len(word) + 1) for s in sides], own


def parities(word: str) -> int:
    """Of 64 classes of letters, those that a word has an odd number of: one edit changes
    two at most."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def keyed(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(word, n) with the keys of both roles, and the word's parities."""
    shared = words.sparkSession.sparkContext.broadcast(order)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [keys_of(w, shared.value) for w in batch["word"].to_pylist()]
            columns = [pa.array([b[i] for b in both], pa.list_(pa.int64())) for i in (0, 1)]
            odd = pa.array([parities(w) for w in batch["word"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], odd, *columns], names=["word", "n", "odd", "as_shorter", "as_longer"])

    return words.select("word", "n").mapInArrow(of_batches, "word string, n long, odd long, as_shorter array<long>, as_longer array<long>")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of (word, n), each once, that differ by one inserted,
    deleted or replaced code point; a is the shorter one, of equal lengths the lesser.

    ``words`` is checkpointed, has each word once, and words of four letters at least.
    """
    both = checkpointed(keyed(words, bigram_order(words)))
    a = both.select(F.explode("as_shorter").alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    b = both.select(F.explode("as_longer").alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    longer = F.length("b") - F.length("a")
    ordered = (longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))
    alike = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2  # cheaper than the distance
    # not hashed in memory: AQE can split the partitions of frequent keys of a sorted join
    met = a.join(b.hint("merge"), "key").where(alike & ordered & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): each word's form, followed to the last, for (word, form).

    Every round doubles the steps that are followed. A form is at least twice as
    frequent as its word, so there are no circles, and 63 steps at most.
    """
    roots = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = roots.join(onward.hint("merge"), "root", "left")
        roots = checkpointed(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.drop("moved")


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, dominant: int = DOMINANT) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``docs`` (doc_id, text).

    A null or empty text has no words and an empty table gives an empty result. A null
    doc_id counts as an empty one when letters are deleted; rows that repeat are
    counted as often; of near words that tie in n the first by code points is the
    form. Very long texts count whole, and so do very long runs. Other columns,
    whatever their names, aren't read.
    """
    words = checkpointed(word_counts(docs).where(F.col("n") >= least_count))
    pairs = near_pairs(words)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).union(pairs.select("b", "a", "n_a"))
    best = F.min(F.struct((-F.col("n_near")).alias("less"), F.col("near"))).alias("best")
    # a word of l letters has at most 181 * l + 90 near words
    of_word = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    fits: Column = -F.col("best.less") >= dominant * F.col("n")
    known = words.join(of_word.hint("merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    known = checkpointed(known)
    roots = followed(known.where(F.col("form").isNotNull()))
    return known.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``documents``. Null, empty,
    very long, repeated and tied rows as in :func:`variants`."""
    found = variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
