"""SentencePiece encoding with a merge-type vocabulary, and decoding.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece
they would make, the leftmost first among equals, and merges from its top until it
is empty. Where no piece of the vocabulary reaches across the start of a word, or
across a character that no longer piece contains, merges can't either; so the text
is cut there and the segments' ids are kept in a bounded table per worker process. In every
Arrow batch the segments that are new are also encoded by the sentencepiece library,
and a difference fails the job. Decoding is the library's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table

MARK = "▁"
CACHE = 150_000  # segments in each of two generations that a worker remembers
CHECK = 20_000  # new segments after which the library is asked, if a batch has more
SHORT = 40  # characters of a segment whose agenda is a list
NEVER = 1 << 30


def merged(text: str, ranks: dict[str, int]) -> list[str]:
    """The pieces of a text (spaces already marked) by the agenda.

    ``ranks`` orders pieces by score, the best first, equal ones alike. A short text's
    agenda is a list with a place for every pair, in which the best is looked up; a
    long text's is a heap.
    """
    return merged_short(text, ranks) if len(text) <= SHORT else merged_long(text, ranks)


def merged_short(text: str, ranks: dict[str, int]) -> list[str]:
    symbols, rank = list(text), ranks.get
    n = len(text) - 1
    agenda = [rank(text[i : i + 2], NEVER) for i in range(n)]
    while n > 0 and (best := min(agenda)) < NEVER:
        i = agenda.index(best)
        symbols[i] = s = symbols[i] + symbols.pop(i + 1)
        del agenda[i]
        n -= 1
        if i < n:
            agenda[i] = rank(s + symbols[i + 1], NEVER)
        if i:
            agenda[i - 1] = rank(symbols[i - 1] + s, NEVER)
    return symbols


def merged_long(text: str, ranks: dict[str, int]) -> list[str]:
    symbols, n = list(text), len(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(symbols[i] + symbols[i + 1])) is not None]
    heapify(agenda)
    while agenda:
        _, left, size = heappop(agenda)
        right = after[left]
        if right >= n or not symbols[left] or len(symbols[left]) + len(symbols[right]) != size:
            continue  # one of the two was merged meanwhile
        symbols[left] += symbols[right]
        symbols[right] = ""
        after[left] = onward = after[right]
        if onward < n:
            before[onward] = left
            if (r := ranks.get(symbols[left] + symbols[onward])) is not None:
                heappush(agenda, (r, left, size + len(symbols[onward])))
        if (back := before[left]) >= 0 and (r := ranks.get(symbols[back] + symbols[left])) is not None:
            heappush(agenda, (r, back, size + len(symbols[back])))
    return [x for x in symbols if x]


class Written(dict):
    """piece -> its id as text; the ids of its bytes, joined by commas, if it is none."""

    def __init__(self, ids: dict[str, int], raw: dict[int, int]):
        super().__init__((p, str(i)) for p, i in ids.items())
        self.raw = raw

    def __missing__(self, piece: str) -> str:
        return ",".join(str(self.raw[b]) for b in piece.encode())


class Pieces(dict):
    """segment -> its ids as text, joined by commas; filled as segments come."""

    def __init__(self, model: str, limit: int = CACHE):
        super().__init__()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        kinds = [(i, lib.id_to_piece(i)) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {p: i for i, p in kinds if not lib.is_byte(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in kinds if lib.is_byte(i)}
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        order = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[score] for p, score in scores.items()}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no bytes to fall back to")
        self.written = Written(self.ids, self.bytes)
        long = [p for p in self.ids if len(p) > 1]
        letters = "".join(sorted(re.escape(c) for c in set("".join(long)) - {MARK}))
        words_end = not any(MARK in p.lstrip(MARK) for p in long)
        self.cut = re.compile(f"{MARK}*[{letters}]+|{MARK}+|[^{letters}{MARK}]" if words_end else ".+", re.DOTALL)
        self.limit, self.new, self.older = limit, [], {}

    def __missing__(self, segment: str) -> str:
        if (out := self.older.get(segment)) is None:
            out = ",".join(map(self.written.__getitem__, merged(segment, self.ranks)))
            self.new.append(segment)
        self[segment] = out
        return out

    def joined(self, marked: str) -> str:
        return ",".join(map(self.__getitem__, self.cut.findall(marked)))

    def encode(self, text: str) -> str:
        """The ids of a whole text, joined by commas."""
        return self.joined(MARK + text.replace(" ", MARK)) if text else ""

    def agrees(self, segments: list[str]) -> bool:
        """Whether the library gives the ids that are held for these segments.

        They stand behind a known word. One that begins a word is cut off by its mark; a
        line break is put before others, and behind marks that stand alone.
        """
        parts = [MARK + "a"]
        for s in segments:
            parts += [s] if s[0] == MARK and s[-1] != MARK else ["\n", s, "\n"] if s[0] == MARK else ["\n", s]
        return self.library.encode("".join(parts)[1:].replace(MARK, " ")) == numbers(",".join([self[s] for s in parts]))

    def check(self) -> None:
        """Compares the segments that are new since the last call with the library.

        They are joined to one text that the library cuts in the same places.
        """
        new = self.new.copy()  # the comparison itself may meet more
        if new and not self.agrees(new):
            wrong = [s for s in new if not self.agrees([s])]
            raise ValueError(f"ids differ from the sentencepiece library's: {wrong or new}")
        self.new.clear()
        if len(self) > self.limit:  # what isn't used again while as many come is forgotten
            self.older = dict(self)
            self.clear()


def numbers(joined: str) -> list[int]:
    return np.fromstring(joined, np.int32, sep=",").tolist() if joined else []


@cache
def pieces_of(model: str) -> Pieces:
    """One table for all tasks that a worker process runs."""
    return Pieces(model)


def model_path(model: str | None) -> str:
    """The given file, or the public vocabulary installed on every machine."""
    if model:
        return model
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded,
    for each row of ``docs``.

    ``model`` is the path of a vocabulary file on every executor. A null text counts
    as empty and has no ids; a very long one is encoded whole. Repeated rows give equal values, an empty table an empty
    result; other columns aren't read. Raises if the library's ids differ.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path(model))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for text in batch["text"]:
                joined = pieces.encode(text.as_py() or "")
                own = numbers(joined)
                back = pieces.library.decode(own) if own else ""
                for column, value in zip(columns, (len(own), sha(joined), sha(back), own, back)):
                    column.append(value)
                if len(pieces.new) > CHECK:
                    pieces.check()
            pieces.check()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of_batches, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``documents``. Null,
    empty, very long and repeated texts as in :func:`encoded`."""
    return encoded(table(spark, sf_dir, "documents"), ids=False)
