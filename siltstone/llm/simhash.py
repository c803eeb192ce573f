"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into SEGMENTS segments on a ring. If two
fingerprints differ in at most t bits, some segment starts a chain in which, for
every length l, the first l segments differ in at most floor(l * t / SEGMENTS) bits
in all. With 7 segments and t = 4 those budgets are 0, 1, 1, 2, 2, 3, 4: the first
segment is equal, and of the next four at least two are, in one of five
combinations. So each fingerprint has 7 * 5 keys of three whole segments (27 bits
or more); fingerprints that share a key become candidates, the chain's budgets prune
them, and the budget of the whole ring is the Hamming check.

Buckets of more than BUCKET fingerprints (large groups of near copies) aren't paired.
Their fingerprints are linked exactly in another way: two of them differ in at most
4 bits if and only if some value lies within 2 bits of both. Each emits the 2081
values within 2 bits of itself, and those that share a value are linked to the
least of them: the rows grow with the group, not with its square.

Links are thinned before they are written: a fingerprint has at most some thousand
smaller neighbours here, which are tied to the least of them. All joins are sorted
and shuffled, so that nothing that grows with the input is built on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, table, text_of
from siltstone.llm.components import components

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEGMENTS = 7
BUCKET = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text as a signed 64-bit number; 0 if it has no words.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, as the definition asks.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key) for each row of ``docs``, the key being a hash of the text; a
    null text counts as empty."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], fps, batch["key"]], ["doc_id", "fp", "key"])

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", text_of(docs).alias("text")).withColumn("key", F.xxhash64("text"))
    return texts.mapInArrow(of_batches, f"doc_id {kind}, fp long, key long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ring(segments: int = SEGMENTS) -> list[int]:
    """The segments' masks."""
    edge = [BITS * i // segments for i in range(segments + 1)]
    return [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(segments)]


def chain_keys(distance: int = DISTANCE, segments: int = SEGMENTS, length: int = 5) -> list[tuple[int, int]]:
    """(start, mask) of the keys: for each start the sets of whole segments, two beside
    the first, of which any chain of ``length`` within its budgets leaves one equal."""
    budget = [l * distance // segments for l in range(segments + 1)]
    masks, keys = ring(segments), []
    for start in range(segments):
        for equal in combinations(range(1, length), 2):
            dirty = [i for i in range(1, length) if i not in equal]
            # the set is needed if all others may differ at once, by one bit each
            if all(sum(1 for d in dirty if d < l) <= budget[l] for l in range(1, length + 1)):
                keys.append((start, masks[start] | masks[(start + equal[0]) % segments] | masks[(start + equal[1]) % segments]))
    return keys


def chain_holds(diff: Column, start: Column, distance: int = DISTANCE, segments: int = SEGMENTS) -> Column:
    """Whether the chain from ``start`` keeps its budget at every length, the whole ring included."""
    masks = ring(segments)
    holds = F.lit(True)
    for l in range(1, segments + 1):
        chains = F.array(*[F.lit(signed(sum(masks[(s + i) % segments] for i in range(l)))) for s in range(segments)])
        holds = holds & (F.bit_count(diff.bitwiseAND(F.element_at(chains, start + 1))) <= l * distance // segments)
    return holds


def near_values(distance: int) -> list[int]:
    """All differences of at most ``distance`` bits."""
    return [signed(sum(1 << b for b in bits)) for n in range(distance + 1) for bits in combinations(range(BITS), n)]


def thinned(edges: DataFrame) -> DataFrame:
    """Ties each node's smaller neighbours, and itself, to the least of them: as connected
    as ``edges`` (a > b), with about one edge for each node.

    A node's neighbours are gathered in an array, so their number must be bounded.
    """
    below = edges.groupBy("a").agg(F.collect_set("b").alias("low")).withColumn("b", F.array_min("low"))
    tied = F.array_append(F.array_remove("low", F.col("b")), F.col("a"))
    return below.select(F.explode(tied).alias("a"), "b").distinct()


def links(classes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints of ``classes`` (distinct values of fp).

    a is the larger, and every edge is within ``distance`` bits. All such pairs that
    share no large bucket are there; those of large buckets are connected through
    shared values within half the distance, so components lose no link. A fingerprint
    has less than ``bucket`` smaller neighbours for each of the 35 keys, and at most
    one for each of the values within half the distance.
    """
    keys = chain_keys(distance)
    masks = [F.struct(F.lit(i).alias("c"), F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, (s, m) in enumerate(keys)]
    keyed = classes.select("fp", F.explode(F.array(*masks)).alias("x")).select("fp", "x.c", "x.start", "x.part")
    shared = keyed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = checkpointed(keyed.join(shared.hint("merge"), ["c", "part"]))
    few, many = met.where(F.col("n") <= bucket), met.where(F.col("n") > bucket)
    other = few.select("c", "part", F.col("fp").alias("b"))
    diff = F.col("fp").bitwiseXOR(F.col("b"))
    pairs = few.join(other.hint("merge"), ["c", "part"]).where((F.col("fp") > F.col("b")) & chain_holds(diff, F.col("start"), distance)).select(F.col("fp").alias("a"), "b")

    near = F.split(F.lit(",".join(map(str, near_values(distance // 2)))), ",").cast("array<bigint>")
    spread = many.select("fp").distinct().select("fp", F.explode(near).alias("v")).select("fp", F.col("fp").bitwiseXOR(F.col("v")).alias("middle"))
    hubs = spread.groupBy("middle").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    stars = spread.join(hubs.hint("merge"), "middle").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, roots: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), fp (signed), component_id.

    With ``roots`` also root, a fingerprint that tells components apart even if they
    share an id or have none.

    Texts without words (null, empty, white space) have fingerprint 0 and are linked
    like any other; of very long texts every shingle counts. The component's id is
    the smallest doc_id reachable, null ids counting only where there are no others;
    rows that repeat, and texts that tie in fingerprint, share a component. An empty
    table gives an empty result; other columns, whatever their names, aren't read.
    """
    fps = checkpointed(fingerprints(docs))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(thinned(links(classes.select("fp"), distance, bucket)))
    joined = classes.join(linked.hint("merge"), classes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    more = ["root"] if roots else []
    of_class = joined.join(least.hint("merge"), "root").select("fp", "component_id", *more)
    return fps.join(of_class.hint("merge"), "fp").select("doc_id", "key", "fp", "component_id", *more)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hexadecimal digits) and component_id of each row of
    ``documents``. Null, empty, repeated and tied texts as in :func:`near_duplicates`."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
