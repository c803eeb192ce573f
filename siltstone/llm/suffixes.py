"""Dedup of repeated passages by suffix arrays of shards.

Every string of LENGTH bytes (a window) that starts anywhere else too is removed. A shard
is a bounded set of passages whose suffixes are sorted by Larsson and Sadakane's
refinement; Kasai's common prefixes tell which of them share LENGTH bytes.

What may be equal has to meet in a shard, so windows are dealt by their contents: a
window's key is the least hash of its grams of GRAM bytes. Equal windows have equal
keys. Neighbouring windows mostly share their key too, and are passed on together, as
one passage. Keys that are the least at one place of the corpus only can't be repeated;
what remains is told by a bitmap. All passages of a key are in one shard. Where a key
is too frequent for that, as words are that a third of all documents have, its windows
get a second key, the least of another hash, which tells apart what stands around the
words. What is too frequent still is much the same text. It is dealt to all shards, each
of which sorts its own, and the shards' different windows, as sorted runs of digests, are
merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, table, text_of
from siltstone.llm.exact_dedup import BITMAP_BITS, filter_size

LENGTH = 200
GRAM = 64
PIECE = 1 << 20  # bytes of text whose keys are worked out at once
PASSAGE = 4096  # windows of a passage at most
FREQUENT = 2048  # places or passages of a key beyond which a shard can't hold them
SHARD = 2 << 20  # bytes of a shard, or as many as the passages of one key have
RUN = 250_000  # windows of a range that is merged, about
BROADCAST_BYTES = 32 << 20  # of all texts' spans

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return (x ^ (x >> np.uint64(29))) * BASE


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring bytes: differences of running sums of a
    polynomial modulo 2^64. Colliding grams only make more candidates."""
    n = len(data)
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    back = np.full(n - size + 1, INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((sums[size:] - sums[:-size]) * back) | np.uint64(1)  # not 0


def sliding(x: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """The least (or largest) of each ``width`` neighbouring values, by what comes first
    and last in blocks of ``width``."""
    take, n = (np.minimum, len(x)) if least else (np.maximum, len(x))
    rows = -(-n // width)
    padded = np.full(rows * width, x[-1], x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = take.accumulate(grid, axis=1).ravel()
    behind = take.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(lengths: np.ndarray, length: int, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, first, last): parts of a run of texts, about ``most`` bytes each, with
    the windows' starts that belong to each text: from ``first`` to before ``last``,
    counted from ``start``. A longer text is cut; each window is in one part."""
    ends = np.cumsum(lengths)
    starts, at, n = ends - lengths, 0, len(lengths)
    while at < n:
        if lengths[at] > most:
            for cut in range(int(starts[at]), int(ends[at]) - length + 1, most):
                stop = min(cut + most + length - 1, int(ends[at]))
                yield cut, stop, np.array([0]), np.array([stop - cut - length + 1])
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        fits = lengths[at:stop] >= length
        if fits.any():
            yield int(starts[at]), int(ends[stop - 1]), (starts[at:stop] - starts[at])[fits], (ends[at:stop] - starts[at] - length + 1)[fits]
        at = stop


def window_keys(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each gram, the starts of the windows within texts, and their keys."""
    hashes = gram_hashes(data, gram)
    at = np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first) + np.arange(int((last - first).sum()))
    return hashes, at, sliding(hashes, length - gram + 1)[at]


def chosen(hashes: np.ndarray, at: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """The hashes of the grams that are the least of any window, once for each place."""
    of_window = np.zeros(len(hashes) + width - 1, np.uint64)
    of_window[at + width - 1] = keys
    return hashes[sliding(of_window, width, least=False) == hashes]


def batch_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, one after the other, and their lengths."""
    texts = batch["text"]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def bodies(docs: DataFrame) -> DataFrame:
    """text (never null) and the two hashes that stand for it: equal texts lose the same."""
    text = text_of(docs)
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"))


def key_counts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, n): at how many places of the corpus a key's gram is the least of a window."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, lengths = batch_bytes(batch)
            parts = [chosen(*window_keys(data[a:b], first, last, length, gram), length - gram + 1) for a, b, first, last in pieces(lengths, length)]
            keys, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select(text_of(docs).alias("text")).mapInArrow(of_batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def keyed_runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int, often: Filter | None) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one key: where they begin and end in the list of
    windows, key, the key before frequent ones got a second, whether it did; and the
    windows' starts."""
    hashes, at, keys = window_keys(data, first, last, length, gram)
    whole, again = keys, np.zeros(len(keys), bool)
    if often is not None and (again := often.has(keys)).any():
        second = sliding(mixed(hashes + MIX), length - gram + 1)[at]
        whole = np.where(again, mixed(keys ^ (second >> np.uint64(1))) | np.uint64(1), keys)
    begins = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]) | (at[1:] != at[:-1] + 1))))
    return begins, np.append(begins[1:], len(at)), whole[begins], keys[begins], again[begins], at


def second_counts(docs: DataFrame, often: Filter, length: int = LENGTH, gram: int = GRAM, most: int = PASSAGE) -> DataFrame:
    """(key, n, windows): of the keys that take the place of frequent ones, how many
    passages and windows have them."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, lengths = batch_bytes(batch)
            keys, windows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for a, b, first, last in pieces(lengths, length):
                begins, stops, own, _, again, _ = keyed_runs(data[a:b], first, last, length, gram, shared.value)
                keys.append(own[again])
                windows.append((stops - begins)[again])
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            sizes = np.concatenate(windows)
            n, total = np.zeros((2, len(found)), np.int64)
            np.add.at(n, at, -(-sizes // most))
            np.add.at(total, at, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(total)], names=["key", "n", "windows"])

    texts = docs.select(text_of(docs).alias("text")).mapInArrow(of_batches, "key long, n long, windows long")
    return texts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))


class Filter:
    """A bitmap of keys, of bounded size: keys that it hasn't aren't repeated (or frequent)."""

    def __init__(self, keys: DataFrame, n: int):
        self.bits = filter_size(n)
        place = F.pmod("key", F.lit(self.bits)) + 1  # Spark counts places from 1
        parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        self.data = np.zeros((self.bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
        for row in parts.toLocalIterator():  # bits / 8 bytes
            own = np.frombuffer(row["bitmap"], np.uint8)
            self.data[row["part"] - 1, : len(own)] = own
        self.data = self.data.ravel()

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = np.mod(keys.view(np.int64), self.bits)  # as pmod
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def passages(docs: DataFrame, repeated: Filter, often: Filter | None, frequent: Filter | None, length: int = LENGTH, gram: int = GRAM, most: int = PASSAGE) -> DataFrame:
    """(t1, t2, at, key, frequent, passage): neighbouring windows with one key that may be
    repeated, as the bytes from the first one's start, ``at``, to the last one's end.
    Each window is in one passage. Keys of ``often`` are replaced by second ones, of
    which those of ``frequent`` are still too frequent for one shard."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((repeated, often, frequent))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, often, too_often = shared.value
        for batch in batches:
            if not len(batch):
                continue
            data, lengths = batch_bytes(batch)
            text_starts = np.cumsum(lengths) - lengths
            t1, t2 = (batch[c].to_numpy() for c in ("t1", "t2"))
            for a, b, first, last in pieces(lengths, length):
                piece = data[a:b]
                begins, stops, own, before, again, at = keyed_runs(piece, first, last, length, gram, often)
                kept = some.has(before)
                begins, stops, own, again = begins[kept], stops[kept], own[kept], again[kept]
                hot = again & too_often.has(own) if too_often is not None else np.zeros(len(own), bool)
                cuts = -(-(stops - begins) // most)
                part = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                own, hot, begins, stops = np.repeat(own, cuts), np.repeat(hot, cuts), np.repeat(begins, cuts) + part * most, np.repeat(stops, cuts)
                start, end = at[begins], at[np.minimum(begins + most, stops) - 1] + length
                text = np.searchsorted(text_starts, start + a, "right") - 1
                raw = piece.tobytes()
                found = pa.array([raw[s:e] for s, e in zip(start.tolist(), end.tolist())], pa.binary())
                columns = [t1[text], t2[text], start + a - text_starts[text], own.view(np.int64), hot]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), found], names=["t1", "t2", "at", "key", "frequent", "passage"])

    return bodies(docs).select("text", "t1", "t2").mapInArrow(of_batches, "t1 long, t2 long, at long, key long, frequent boolean, passage binary")


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all suffixes in order, and each suffix's place, by Larsson and
    Sadakane's refinement: suffixes that agree in h bytes are ordered by the places of
    those h bytes further on, for h = 8, 16, 32 and so on, and only groups that aren't
    settled are sorted again."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(words)
    heads = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    alone = heads & np.append(heads[1:], True)
    open_at, h = np.flatnonzero(~alone), 8
    while len(open_at):
        suffix = order[open_at]
        beyond = suffix + h
        # what ends first comes first
        after = np.where(beyond < n, place[np.minimum(beyond, n - 1)] + n, n - 1 - suffix)
        key = place[suffix] * (2 * n) + after
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_at] = suffix
        heads = np.concatenate(([True], key[1:] != key[:-1]))
        place[suffix] = np.maximum.accumulate(np.where(heads, open_at, 0))
        open_at = open_at[~(heads & np.append(heads[1:], True))]
        h *= 2
    return order, place


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many bytes each suffix in ``order`` shares with the one before it.

    Kasai's rule: going through the text, the length falls by one at most from one
    suffix to the next. Where the bytes before a suffix and before its neighbour are
    equal it falls by exactly one; only the others are compared, all at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    both = (at > 0) & (before > 0)
    follows[both] = data[at[both] - 1] == data[before[both] - 1]
    i = np.flatnonzero(~follows & (before >= 0))
    j, length = before[i], np.zeros(n, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + 1,), ">u8", padded.tobytes(), strides=(1,))
    size = 0
    while len(i):
        x, y = i + size, j + size
        inside = (x < n) & (y < n)
        differs = words[np.minimum(x, n)].astype(np.uint64) ^ words[np.minimum(y, n)].astype(np.uint64)
        more = inside & (differs == 0)
        done = ~more
        unlike = differs[done].astype(">u8").view(np.uint8).reshape(-1, 8) > 0
        equal = np.where(unlike.any(axis=1), unlike.argmax(axis=1), 8)  # bytes of the word
        length[i[done]] = np.minimum(size + equal, n - np.maximum(i[done], j[done]))
        i, j, size = i[more], j[more], size + 8
    # of suffixes that follow another, its length less the steps between
    base = np.maximum.accumulate(np.where(follows, -1, at))
    length = length[base] - (at - base)
    return length[order]


def repeated_windows(passage_list: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, offset, class, repeated) of all windows of different passages, in the
    suffixes' order; windows of a class are equal. ``copies`` says how often each
    passage occurs."""
    sizes = np.array([len(p) for p in passage_list], np.int64)
    data = np.frombuffer(b"".join(passage_list), np.uint8)
    order, place = suffix_array(data)
    shared = common_prefixes(data, order, place)
    starts = np.cumsum(sizes) - sizes
    passage = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(data)) - starts[passage]
    whole = (offset + length <= sizes[passage])[order]  # suffixes that are windows; others reach into the next passage
    kept = np.flatnonzero(whole)
    at = order[kept]
    # of two windows, the least of the lengths from one to the other
    least = np.minimum.reduceat(shared[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1))) if len(kept) else shared[:0]
    heads = least < length
    heads[:1] = True
    number = np.cumsum(heads) - 1
    often = np.bincount(number, weights=copies[passage[at]]) > 1
    return passage[at], offset[at], number, often[number]


SPANS = "t1 long, t2 long, start long, stop long, range int, digests binary, places binary"
PLACE = np.dtype([("t1", "<i8"), ("t2", "<i8"), ("at", "<i8"), ("open", "?")])


def shard_rows(rows: pa.Table, length: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The repeated passages of a shard as (t1, t2, start, stop), and the runs of the
    frequent keys' windows: range, digests in order, places."""
    all_passages = rows["passage"].to_pylist()
    digests = np.array([xxhash.xxh3_128_digest(p) for p in all_passages], dtype="S16")
    _, first, inverse, copies = np.unique(digests, return_index=True, return_inverse=True, return_counts=True)
    distinct = [all_passages[i] for i in first.tolist()]
    passage, offset, number, often = repeated_windows(distinct, copies, length)

    # every row has the windows of its passage: runs of repeated ones become spans
    hits = np.lexsort((offset[often], passage[often]))
    p, o = passage[often][hits], offset[often][hits]
    heads = np.concatenate(([True], (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)))[: len(p)]
    begin = np.flatnonzero(heads)
    of, start, stop = p[begin], o[begin], o[np.append(begin[1:], len(o)) - 1] + length if len(begin) else o[:0]
    per = np.bincount(of, minlength=len(distinct))
    firsts = np.cumsum(per) - per
    times = per[inverse]
    row = np.repeat(np.arange(len(inverse)), times)
    span = np.repeat(firsts[inverse] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    t1, t2, at = (rows[c].to_numpy() for c in ("t1", "t2", "at"))
    none = lambda kind: pa.nulls(len(row), kind)
    yield pa.RecordBatch.from_arrays([*map(pa.array, (t1[row], t2[row], at[row] + start[span], at[row] + stop[span])), none(pa.int32()), none(pa.binary()), none(pa.binary())], names=[c.split()[0] for c in SPANS.split(", ")])

    frequent = rows["frequent"].to_numpy()[first]
    heads = np.append(True, number[1:] != number[:-1])[: len(number)] & frequent[passage]
    passage, offset, often = passage[heads], offset[heads], often[heads]
    if len(passage):
        digests = np.array([xxhash.xxh3_128_digest(distinct[i][k : k + length]) for i, k in zip(passage.tolist(), offset.tolist())], dtype="V16")
        places = np.zeros(len(passage), PLACE)
        one = first[passage]  # of a window that isn't repeated the only row
        places["t1"], places["t2"], places["at"], places["open"] = t1[one], t2[one], at[one] + offset, ~often
        high = digests.view(">u8").reshape(-1, 2)[:, 0].astype(np.uint64)
        by = np.lexsort((digests.view(">u8").reshape(-1, 2)[:, 1], high))
        digests, places, high = digests[by], places[by], high[by]
        edges = np.searchsorted(high, (np.arange(ranges + 1, dtype=np.float64) * (2.0**64 / ranges)).clip(0, 2.0**64 - 4096).astype(np.uint64))
        edges[-1] = len(high)
        own = np.flatnonzero(np.diff(edges))
        out = [(int(r), digests[edges[r] : edges[r + 1]].tobytes(), places[edges[r] : edges[r + 1]].tobytes()) for r in own]
        empty = [pa.nulls(len(out), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*empty, pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[k] for x in out], pa.binary()) for k in (1, 2)]], names=[c.split()[0] for c in SPANS.split(", ")])


def sharded(found: DataFrame, length: int, ranges: int, shard: int = SHARD) -> DataFrame:
    """The rows of :func:`shard_rows` of all shards: passages are dealt by key, those of
    frequent keys by place, and cut into shards where a key ends."""
    schema = "t1 long, t2 long, at long, key long, frequent boolean, passage binary"

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys, frequent = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "frequent"))
            ends = np.cumsum(pc.binary_length(batch["passage"]).to_numpy()).astype(np.int64)
            at, before = 0, 0
            last = held[-1]["key"][-1].as_py() if held else None
            # places where a shard may end: a new key begins, or the key is frequent
            for i in np.flatnonzero(np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1])) | frequent).tolist() if len(keys) else []:
                inside = int(ends[i - 1]) - before if i else 0
                if size + inside >= shard:
                    held.append(batch.slice(at, i - at))
                    yield from shard_rows(pa.Table.from_batches([b for b in held if len(b)]).combine_chunks(), length, ranges)
                    held, size, at, before = [], 0, i, int(ends[i - 1]) if i else 0
            if at < len(batch):
                held.append(batch.slice(at))
                size += int(ends[-1]) - before
        if size:
            yield from shard_rows(pa.Table.from_batches(held).combine_chunks(), length, ranges)

    # copies of a text have the same places, so that a row's own number spreads them
    place = F.when(F.col("frequent"), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("key"))
    dealt = found.select(*[c.split()[0] for c in schema.split(", ")]).repartition(place).sortWithinPartitions("frequent", "key")
    return dealt.mapInArrow(of_batches, SPANS)


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The open places of runs whose digests another run has. Runs are merged two by two:
    each of the second's digests is looked for in the first by binary search."""
    out = []
    while len(runs) > 1:
        merged = []
        for (a, pa_), (b, pb) in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(a, b)
            met = np.flatnonzero((at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b))
            for places, index in ((pa_, at[met]), (pb, met)):
                out.append(places[index][places["open"][index]])
                places["open"][index] = False
            new = np.ones(len(b), bool)
            new[met] = False
            merged.append((np.insert(a, at[new], b[new]), np.insert(pa_, at[new], pb[new])))
        runs = merged + runs[len(runs) - len(runs) % 2 :]
    return np.concatenate(out) if out else np.empty(0, PLACE)


def merged(runs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, stop) of windows of frequent keys that are in several shards, by ranges of their digests."""

    def of_range(rows: pa.Table) -> pa.Table:
        decoded = []
        for digests, places in zip(rows["digests"].to_pylist(), rows["places"].to_pylist()):
            decoded.append((np.frombuffer(digests, "S16"), np.frombuffer(places, PLACE).copy()))
        found = merged_runs(decoded)
        return pa.table({"t1": found["t1"], "t2": found["t2"], "start": found["at"], "stop": found["at"] + length})

    return runs.groupBy("range").applyInArrow(of_range, "t1 long, t2 long, start long, stop long")


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch as one."""
    out: list[list[int]] = []
    for start, stop in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, often: int = FREQUENT, shard: int = SHARD, run: int = RUN) -> DataFrame:
    """t1, t2 (of :func:`bodies`) and spans, array<struct<start, stop>>, of each text that
    has windows that start anywhere else too: what they cover, in bytes, in order."""
    counts = checkpointed(key_counts(docs, length, gram).where("n > 1"))
    repeated, frequent = counts.select("key"), counts.where(F.col("n") > often).select("key")
    some, again, still, ranges = Filter(repeated, repeated.count()), None, None, 1
    if n := frequent.count():
        again = Filter(frequent, n)
        second = checkpointed(second_counts(docs, again, length, gram).where(F.col("n") > often))
        total = second.agg(F.count(F.lit(1)).alias("n"), F.sum("windows").alias("windows")).first()
        if total["n"]:
            still, ranges = Filter(second.select("key"), total["n"]), 1 + total["windows"] // run
    rows = checkpointed(sharded(passages(docs, some, again, still, length, gram), length, ranges, shard))
    spans = rows.where(F.col("range").isNull()).select("t1", "t2", "start", "stop")
    if still is not None:
        spans = spans.union(merged(rows.where(F.col("range").isNotNull()).select("range", "digests", "places"), length))

    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"start": a, "stop": b} for a, b in joined_spans(sorted((x["start"], x["stop"]) for x in spans))] for spans in batch["all"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["t1"], batch["t2"], pa.array(out, kind)], names=["t1", "t2", "spans"])

    # a text's spans are as many as its passages, which its length bounds; copies of a text have the same
    grouped = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("all"))
    return checkpointed(grouped.mapInArrow(of_batches, "t1 long, t2 long, spans array<struct<start:long,stop:long>>"))


def without_repeats(docs: DataFrame, text: bool = True, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    asked for, spans and kept (the remaining bytes).

    A null text counts as empty; shorter texts than LENGTH bytes stay whole; a row that
    repeats another loses all its windows, as both do. Of a very long text every window
    is judged. Other columns, whatever their names, aren't read; an empty table
    gives an empty result. Two texts are taken for one if both of two 64-bit hashes are
    the same, as are windows of frequent keys whose 128-bit digests are.
    """
    spans = repeated_spans(docs, **options)
    kind = dict(docs.dtypes)["doc_id"]
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("spans")).alias("m")).first()
    side = spans.select(F.col("t1").alias("s1"), F.col("t2").alias("s2"), "spans")
    side = F.broadcast(side) if 64 * size["n"] + 32 * (size["m"] or 0) <= BROADCAST_BYTES else side.hint("merge")
    body = bodies(docs)
    joined = body.join(side, (body["t1"] == side["s1"]) & (body["t2"] == side["s2"]), "left").select("doc_id", "text", "spans")
    more = ", spans array<struct<start:long,stop:long>>, kept binary" if text else ""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, lengths = batch_bytes(batch)
            ends, raw = np.cumsum(lengths).tolist(), memoryview(np.ascontiguousarray(data))
            rows = []
            for spans, end, n in zip(batch["spans"].to_pylist(), ends, lengths.tolist()):
                own, at, kept, removed = raw[end - n : end], 0, [], 0
                for x in spans or []:
                    kept.append(own[at : x["start"]])
                    at, removed = x["stop"], removed + x["stop"] - x["start"]
                rest = b"".join([*kept, own[at:]])
                rows.append((n, removed, len(spans or []), hashlib.sha256(rest).hexdigest(), *([spans or [], rest] if text else [])))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if text else [])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", *names])

    return joined.mapInArrow(of_batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``documents``. Null,
    empty, very long, repeated and tied rows as in :func:`without_repeats`."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False)
