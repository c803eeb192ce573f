"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which of another.

A text is encoded with a byte-level vocabulary (A) and with a SentencePiece one (B),
which give the same bytes. The tokens' ends are running sums of their lengths; where
both end, the text is cut into groups, and every A token of a group is linked to every
B token of it. All of that is done on the arrays of a block of documents at once: ends
by ``cumsum``, cuts by ``intersect1d``, groups by ``searchsorted``, links by ``repeat``.

A block's row keeps, for each document, its different id pairs and how often it has
them. How many documents of the corpus hold a pair is summed up in a task, then by
pair and salt, then by pair. If a count shows that the pairs' table is small it is
broadcast to the blocks, else what a block needs of it is brought to the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, table

MARK = "▁"
BLOCK = 1 << 21  # bytes of a block's texts; a longer text is a block by itself
SLICE = 1 << 21  # links that are expanded at once
HELD = 1 << 21  # pairs that a task sums up before it passes them on
SALTS = 16
SMALL = 4_000_000  # pairs of a table that is broadcast: 13 bytes each
LATIN = "ɏ"  # up to here, both libraries of vocabulary A cut a text alike
CODEC = "zstd"


class Vocabularies:
    """Both tokenizers, with the bytes, lengths and decimal forms of their tokens.

    Vocabulary A's rules are in ``a_json``; ``a_ranks`` has the same vocabulary for a
    faster library, which cuts texts by the same pattern. They might disagree on what
    is a letter among characters that Unicode has added late, so texts beyond
    Latin take the first.
    """

    def __init__(self, a_json: str, a_ranks: str, b_model: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        with open(a_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = lib = sentencepiece.SentencePieceProcessor(model_file=b_model)
        letters = byte_letters()
        of_id = {i: bytes(letters.get(c, 0) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [of_id.get(i, b"") for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        pieces = [(i, lib.id_to_piece(i)) for i in range(lib.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # a token with what follows it: A within a side and at its end, then B likewise
        self.shift = len(self.a_bytes)
        self.written = [f"{i}{end}" for n, ends in ((self.shift, ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both; none if the text is empty or either's bytes aren't the text's."""
        if not text:
            return [], []
        spaced = " " + text
        a = self.fast.encode_ordinary(spaced) if text.isascii() or max(text) <= LATIN else self.a.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw = spaced.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return (a, b) if same else ([], [])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others in order for those from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@cache
def vocabularies(a_json: str | None, a_ranks: str | None, b_model: str | None) -> Vocabularies:
    """One pair for all tasks of a worker: the given files, or the public vocabularies
    that are installed on every machine."""
    import public_tokenizers

    path = public_tokenizers.path
    return Vocabularies(a_json or path("byte_bpe_50k.json"), a_ranks or path("byte_bpe_50k.tiktoken"), b_model or path("piece_bpe_32k.model"))


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and each B token, and the number of groups, from the tokens'
    sizes, which sum up to the same."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), len(cuts)


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of their weights."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def linked(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, doc: np.ndarray, most: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """The different keys document << 32 | A id << 16 | B id of all links, in order, and
    how often each occurs. ``doc`` is that of each A token. About ``most`` links are
    expanded at once, however large a group is."""
    n_b = np.bincount(b_group, minlength=int(a_group[-1]) + 1)
    first_b = np.cumsum(n_b) - n_b
    partners = n_b[a_group]
    ends = np.cumsum(partners)
    high = (doc.astype(np.int64) << 32) | (a_ids.astype(np.int64) << 16)
    keys, times, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while at < len(a_ids):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - partners[at] + most, "right")))
        own = partners[at:stop]
        start = np.repeat(first_b[a_group[at:stop]] - (np.cumsum(own) - own), own)
        found, n = np.unique(np.repeat(high[at:stop], own) | b_ids[start + np.arange(len(start))], return_counts=True)
        keys, times = (found, n) if not len(keys) else counted(np.concatenate((keys, found)), np.concatenate((times, n)))
        at = stop
    return keys, times


def written(v: Vocabularies, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> np.ndarray:
    """Where in ``v.written`` each token of all groups is: A's of a group, then B's."""
    n_groups = int(a_group[-1]) + 1
    n_a, n_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    out = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
    out[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[a_group]] = a + last_a * v.shift
    out[np.arange(len(b)) + np.cumsum(n_a)[b_group]] = b + 2 * v.shift + last_b * len(v.b_bytes)
    return out


def packed(values: np.ndarray, kind) -> bytes:
    return pa.compress(np.ascontiguousarray(values, kind).tobytes(), codec=CODEC, asbytes=True) if len(values) else b""


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec=CODEC) if n else b"", kind)


def block_row(v: Vocabularies, texts: list[str]) -> dict:
    """What is kept of a block of documents. ``pairs`` are A id << 16 | B id, in order;
    ``holders`` how many documents hold each; a document's ``n_pairs`` entries of
    ``places`` (among ``pairs``) and ``times`` follow the previous one's."""
    ids = [v.ids(t) for t in texts]
    n_a, n_b = (np.array([len(x[i]) for x in ids], np.int64) for i in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
    n_groups, n_links, digests = np.zeros_like(n_a), np.zeros_like(n_a), [""] * len(ids)
    keys, times = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a):
        a_group, b_group, _ = groups(v.a_sizes[a], v.b_sizes[b])
        doc = np.repeat(np.arange(len(ids)), n_a)
        keys, times = linked(a, b, a_group, b_group, doc)
        last = a_group[np.cumsum(n_a) - 1]  # a document's last group; texts without tokens have that of the one before
        n_groups = np.where(n_a > 0, np.diff(np.concatenate(([-1], np.where(np.cumsum(n_a) > 0, last, -1)))), 0)
        n_links = np.bincount(keys >> 32, weights=times, minlength=len(ids)).astype(np.int64)
        names, shown, end = v.written, written(v, a, b, a_group, b_group), np.cumsum(n_a + n_b)
        for i, (stop, n) in enumerate(zip(end.tolist(), (n_a + n_b).tolist())):
            if n:
                digests[i] = hashlib.sha256("".join(map(names.__getitem__, shown[stop - n : stop].tolist()))[:-1].encode()).hexdigest()
    pairs, places = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
    holders = np.bincount(places, minlength=len(pairs))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests,
        "n_pairs": np.bincount(keys >> 32, minlength=len(ids)), "pairs": packed(pairs, np.uint32), "holders": packed(holders, np.uint32),
        "places": packed(places, np.uint32), "times": packed(times, np.uint32), "size": len(pairs),
    }


LONGS = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")
BYTES = ("pairs", "holders", "places", "times")


def blocks(docs: DataFrame, paths: tuple = (None, None, None), most: int = BLOCK) -> DataFrame:
    """One row per block of documents: block, doc_ids, and the columns of :func:`block_row`."""
    kind = dict(docs.dtypes)["doc_id"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, number = vocabularies(*paths), TaskContext.get().partitionId() << 32

        def row(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            x = block_row(v, texts)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids)]
            columns += [pa.array([x[c].tolist()], pa.list_(pa.int64())) for c in LONGS] + [pa.array([x["groups_sha256"]], pa.list_(pa.string()))]
            columns += [pa.array([x[c]], pa.binary()) for c in BYTES] + [pa.array([x["size"]], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", *LONGS, "groups_sha256", *BYTES, "size"])

        for batch in batches:
            texts = batch["text"]
            ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])) if len(texts) else []
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                yield row(batch["doc_id"][at:stop], texts[at:stop].to_pylist())
                number, at = number + 1, stop

    schema = f"block long, doc_ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in LONGS) + ", groups_sha256 array<string>, " + ", ".join(f"{c} binary" for c in BYTES) + ", size long"
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(of_batches, schema)


def block_pairs(kept: DataFrame, merged: bool) -> DataFrame:
    """(block, pair, n): the pairs of each block with the documents that hold them; with
    ``merged``, summed up over the blocks of a task, and block is null."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, waiting = [], [], 0

        def passed(block: int | None, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.int64()), pa.array(keys), pa.array(counts)], names=["block", "pair", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = (unpacked(row[c], row["size"], np.uint32).astype(np.int64) for c in ("pairs", "holders"))
                if not merged:
                    yield passed(row["block"], keys, counts)
                    continue
                held, n, waiting = [*held, keys], [*n, counts], waiting + len(keys)
                if waiting > HELD:
                    keys, counts = counted(np.concatenate(held), np.concatenate(n))
                    if len(keys) > HELD // 2:
                        yield passed(None, keys, counts)
                        held, n, waiting = [], [], 0
                    else:
                        held, n, waiting = [keys], [counts], len(keys)
        if held:
            yield passed(None, *counted(np.concatenate(held), np.concatenate(n)))

    return kept.select("block", "pairs", "holders", "size").mapInArrow(of_batches, "block long, pair long, n long")


def pair_counts(kept: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold each id pair, and whether no other pair of
    its A id is held by more."""
    partial = block_pairs(kept, True).withColumn("salt", F.spark_partition_id() % SALTS)
    whole = partial.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    whole = checkpointed(whole.withColumn("a", F.shiftright("pair", 16)))
    most = whole.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A
    return checkpointed(whole.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def finished(row: dict, n: np.ndarray, best: np.ndarray) -> list[np.ndarray]:
    """n_best and count_sum of a block's documents, from its pairs' counts."""
    n_pairs = np.array(row["n_pairs"], np.int64)
    size = int(n_pairs.sum())
    places, times = (unpacked(row[c], size, np.uint32).astype(np.int64) for c in ("places", "times"))
    doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
    sums = [np.zeros(len(n_pairs), np.int64) for _ in range(2)]
    for out, values in zip(sums, (best, n)):
        np.add.at(out, doc, values[places] * times)
    return sums


def columns_of(row: dict, ids: pa.Array, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The rows of a block's documents."""
    n_best, count_sum = finished(row, n, best)
    longs = [pa.array(x, pa.int64()) for x in (*[row[c] for c in LONGS[:4]], n_best, count_sum)]
    return pa.RecordBatch.from_arrays([ids, *longs, pa.array(row["groups_sha256"], pa.string())], names=["doc_id", *LONGS[:4], "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, paths: tuple = (None, None, None), small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    ``paths`` are the vocabularies' files on every executor. A null or empty text, and
    one whose bytes a vocabulary doesn't give back, has no tokens, and an empty digest.
    Rows that repeat count as often; pairs of an A id that tie are all its best. A very
    long text is a block by itself; its links are expanded in slices. Other columns,
    whatever their names, aren't read; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    kept = checkpointed(blocks(docs, paths, block))
    counts = pair_counts(kept)
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    if counts.count() <= small:
        table = counts.orderBy("pair").toArrow()
        keys, n, best = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
        shared = docs.sparkSession.sparkContext.broadcast((keys.astype(np.uint32), n.astype(np.int64), best))

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_pairs, n, best = shared.value
            for batch in batches:
                for i, row in enumerate(batch.drop_columns(["doc_ids"]).to_pylist()):
                    at = np.searchsorted(all_pairs, unpacked(row["pairs"], row["size"], np.uint32))
                    yield columns_of(row, batch["doc_ids"][i].values, n[at], best[at])

        return kept.mapInArrow(of_batches, schema)

    needed = block_pairs(kept, False).select("block", "pair").join(counts, "pair")

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["doc_ids"]).to_pylist()[0]
        order = np.argsort(right["pair"].to_numpy())
        n, best = (right[c].to_numpy()[order] for c in ("n", "best"))
        return pa.Table.from_batches([columns_of(row, left["doc_ids"].chunk(0)[0].values, n, best)])

    return kept.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(of_block, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row
    of ``documents``. Null, empty, very long, repeated and tied rows as in :func:`aligned`."""
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
