"""Language identification of mixed-language texts, word by word.

Training counts hashed character n-grams of words per language. Scripts, told by
ranges of code points, narrow a word's candidates to the languages that were seen in
its script. Every word has a score per candidate (the log-likelihood of its n-grams),
and Viterbi with a switching penalty finds the best sequence of languages, whose
runs are the labelled spans. A text's language is the one with the most letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table

TRAIN_ROWS = 6000  # expected bound of the training sample
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
PENALTY = 6.0
UNLIKELY = -30.0  # for languages never seen in the word's script
CACHE = 300_000  # words that a task remembers
CELLS = 8_000_000  # word scores held at once
PART = 50_000  # words whose n-grams are hashed at once
UNDETERMINED = "und"

LETTERS = re.compile(r"[^\W\d_]+")

# First and last code points of scripts, from the Unicode blocks.
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F)],
    "devanagari": [(0x0900, 0x097F)],
    "thai": [(0x0E00, 0x0E7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
}
SCRIPT_NAMES = [*SCRIPTS, "other"]


@cache
def script_of(letter: str) -> int:
    c = ord(letter)
    return next((i for i, ranges in enumerate(SCRIPTS.values()) if any(a <= c <= b for a, b in ranges)), len(SCRIPTS))


def script(word: str) -> int:
    """The number of the script of a word's first letter."""
    return script_of(word[0])


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, bucket) of every n-gram of the words, their edges marked, and of
    each word as a whole. All n-grams of one length are hashed at once."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, buckets = [np.arange(len(words))], [np.array([crc32(w.encode()) % BUCKETS for w in words], np.int64)]
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            whole = owner[: len(h)] == owner[n - 1 :]
            mixed = (h[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            owners.append(owner[: len(h)][whole])
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages), log-probabilities
    scripts: np.ndarray  # (scripts, languages), whether seen


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the rows at most, by a hash of the id: alike in every run."""
    share = rows / max(rows, docs.select("doc_id").count())
    return docs.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from (doc_id, text, lang) where lang isn't null, on a bounded sample.

    What reaches the driver is a count for each language and bucket: its size
    doesn't depend on the corpus. Without any row the model knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                words.setdefault(lang.as_py(), Counter()).update(LETTERS.findall(text.as_py().lower()))
        for lang, counts in words.items():
            sums, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
            known, times = list(counts), np.array([*counts.values()], np.int64)
            for start in range(0, len(known), PART):
                owner, bucket = gram_buckets(known[start : start + PART])
                sums += np.bincount(bucket, weights=times[start + owner], minlength=BUCKETS).astype(np.int64)
            for word, n in counts.items():
                scripts[script(word)] += n
            both = np.concatenate((sums, scripts))
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(both[at])], names=["lang", "at", "n"])

    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")  # counted without the texts
    found = sampled(known, rows).where(F.col("text").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    counts[found["at"].to_numpy(dtype=np.int64), [languages.index(x) for x in found["lang"]]] = found["n"]
    seen = counts[BUCKETS:]
    sums = counts[:BUCKETS] + 0.5
    return Model(languages, np.log(sums / sums.sum(axis=0)).astype(np.float32), seen > 0.01 * np.maximum(seen.sum(axis=0), 1))


class Words(dict):
    """word -> row of ``scores``. New words get a row as they come and their scores
    together, in ``complete``; all are forgotten when there are too many."""

    def __init__(self, model: Model, limit: int = CACHE):
        super().__init__()
        self.model, self.limit, self.new = model, limit, []
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def complete(self) -> None:
        model, scores = self.model, [self.scores]
        for start in range(0, len(self.new), PART):
            part = self.new[start : start + PART]
            owner, bucket = gram_buckets(part)
            sums = np.stack([np.bincount(owner, weights=model.weights[bucket, i], minlength=len(part)) for i in range(len(model.languages))], axis=1)
            lengths = np.array([len(w) for w in part])
            # n-grams overlap: the mean, times the letters, weighs a word by its length
            own = sums / np.bincount(owner)[:, None] * np.minimum(lengths, 12)[:, None]
            seen = model.scripts[[script(w) for w in part]]
            own[~seen & seen.any(axis=1)[:, None]] = UNLIKELY * 12  # where no language was seen, all stay candidates
            scores.append(own.astype(np.float32))
        if self.new:
            self.scores = np.concatenate(scores)
            # the words' pattern also takes numbers such as ² and Ⅷ, which aren't letters
            letters = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in self.new]
            self.letters = np.concatenate((self.letters, letters)).astype(np.int64)
            self.new = []

    def forget(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.scores, self.letters = self.scores[:0], self.letters[:0]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of every word of several texts at once.

    ``scores`` has the texts' words one text after another; ``lengths`` the number of
    words of each, in descending order. A step handles the next word of all texts
    that have one. Of equal paths the one that stays, then the first language, wins.
    """
    total, kinds = scores.shape
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    longest = int(lengths[0]) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    back = np.zeros((total, kinds), np.int8 if kinds < 128 else np.int32)
    best, own = np.zeros((len(lengths), kinds), np.float32), np.arange(kinds)
    for t in range(longest):
        n = active[t]
        at = starts[:n] + t
        if t:
            top = best[:n].argmax(axis=1)
            switch = best[:n][np.arange(n), top] - penalty
            leave = best[:n] < switch[:, None]
            back[at] = np.where(leave, top[:, None], own)
            best[:n] = np.where(leave, switch[:, None], best[:n]) + scores[at]
        else:
            best[:n] = scores[at]
    out = np.zeros(total, np.int32)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return out


def labelled(texts: list[str], words: Words, penalty: float, spans: bool) -> list[tuple]:
    """(language, share of letters, spans) of each text; spans as (first, last, language) in words."""
    names = words.model.languages
    rows = [np.fromiter(map(words.__getitem__, LETTERS.findall(t.lower())), np.int64) for t in texts]
    words.complete()
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    lengths = np.array([len(rows[i]) for i in order])
    flat = np.concatenate([rows[i] for i in order]) if rows else np.zeros(0, np.int64)
    path = viterbi(words.scores[flat], lengths, penalty)
    text_of_word = np.repeat(np.arange(len(order)), lengths)
    letters = np.bincount(text_of_word * len(names) + path, weights=words.letters[flat], minlength=len(order) * len(names)).reshape(-1, len(names))
    out: list = [None] * len(texts)
    ends = np.cumsum(lengths)
    for place, i in enumerate(order):
        total = letters[place].sum()
        if not total:
            out[i] = (UNDETERMINED, 0.0, [])
            continue
        top = int(letters[place].argmax())
        runs = []
        if spans:
            own = path[ends[place] - lengths[place] : ends[place]]
            cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
            runs = [{"first": int(a), "last": int(b) - 1, "lang": names[own[a]]} for a, b in zip(cuts, cuts[1:])]
        out[i] = (names[top], float(letters[place, top] / total), runs)
    return out


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans for each row of ``docs``.

    ``score`` is the share of the text's letters in spans of that language. Null
    texts, texts without letters, and all texts if the model knows no language, are
    ``und`` with score 0. Of equal languages the first by name wins; repeated rows get
    equal values; an empty table gives an empty result; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        most = CELLS // max(1, len(shared.value.languages))
        for batch in batches:
            found, part, held = [], [], 0
            for text in batch["text"]:
                text = text.as_py() or ""
                if not shared.value.languages:
                    found.append((UNDETERMINED, 0.0, []))
                    continue
                part.append(text)
                held += len(text) // 4
                if held > most:
                    found += labelled(part, words, penalty, spans)
                    part, held = [], 0
                    words.forget()
            found += labelled(part, words, penalty, spans) if part else []
            words.forget()
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            columns += [pa.array([f[2] for f in found], run)] if spans else []
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "lang_pred", "score", *(["spans"] if spans else [])])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang_pred string, score double" + (", spans array<struct<first:int,last:int,lang:string>>" if spans else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of_batches, schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``documents``, by a model of the
    rows that aren't held out. Null, empty, very long and repeated texts as in
    :func:`identify`, which labels whole texts; a null doc_id isn't learned from and has
    a null held_out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    return identify(docs, model, spans=False).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
