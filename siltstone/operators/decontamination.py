"""Benchmark contamination: exact, n-gram, substring and vector matches, and the policy.

Evidence rows are id, benchmark, item_index, method, confidence. Benchmarks are the
small side: their hashes, grams and runs of words are one index, which is broadcast if
a count shows it small. Texts are normalised once, and looked up in it by all rules in
one pass; only candidates for a substring are read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import bound, grams, normalize_decon, words
from siltstone.operators.keyfilter import known
from siltstone.plans.sizes import BROADCAST_ROWS, bounded, stored

THRESHOLD = 0.85
GRAM = 5
TOP_K = 3
REVIEW_THRESHOLD = 0.92
HARD_FAIL = ("exact", "ngram")
REVIEW = ("substring", "embedding")
SUBSTRING_CONFIDENCE = 0.99
MATCHED_TEXT = 200
LOOKED_UP = 5  # words of an item that is looked up by a run of three of its inner words
BLOCK = 2048  # vectors of a block
RULES = ("exact", "ngram", "substring")


def _keys(norm: Column, rules, n: int) -> Column:
    """array<struct<rule, key>> under which a normalised text is looked up."""
    none = F.array().cast("array<struct<rule:string,key:string>>")
    tag = lambda rule, keys: F.transform(keys, lambda k: F.struct(F.lit(rule).alias("rule"), k.alias("key")))

    def of(x: Column) -> Column:
        whole = [tag("exact", F.array(F.md5(x)))] if "exact" in rules else []
        runs = lambda w: F.concat(none, *[tag(rule, grams(w, size)) for rule, size in (("ngram", n), ("substring", 3)) if rule in rules])
        return F.concat(none, *whole, bound(words(x), runs))

    return bound(norm, of)


def prepared(bench: DataFrame) -> DataFrame:
    """benchmark, item_index, norm of the items that have a letter or digit, stored."""
    items = bench.select("benchmark", "item_index", normalize_decon(F.col("text")).alias("norm"))
    return stored(items.where(F.trim("norm") != ""))


def indexed(items: DataFrame, rules=RULES, n: int = GRAM) -> DataFrame:
    """rule, key, benchmark, item_index, keys (the item's number of them by that rule).

    For a substring an item of five words or more has one key, a run of three words
    within it: those are whole words of any text that contains the item.
    """
    tokens, none = words(F.col("norm")), F.array().cast("array<struct<rule:string,key:string>>")
    inner = F.struct(F.lit("substring").alias("rule"), F.array_join(F.slice(tokens, 2, 3), " ").alias("key"))
    run = F.when(F.size(tokens) >= LOOKED_UP, F.array(inner)).otherwise(none) if "substring" in rules else none
    own = F.concat(_keys(F.col("norm"), [r for r in rules if r != "substring"], n), run)
    flat = items.select("benchmark", "item_index", F.explode(own).alias("x")).select("x.rule", "x.key", "benchmark", "item_index")
    sizes = flat.groupBy("benchmark", "item_index", "rule").agg(F.count(F.lit(1)).alias("keys"))
    return flat.join(sizes, ["benchmark", "item_index", "rule"])


def _met(examples: DataFrame, index: DataFrame, rules, n: int) -> DataFrame:
    """(id, rule, key) of the keys of a small index that an example has, looked up in tasks
    that hold them: no row is made for a gram that no item has."""
    held: dict[str, set] = {rule: set() for rule in rules}
    for row in index.select("rule", "key").distinct().collect():  # BROADCAST_ROWS at most
        held[row["rule"]].add(row["key"])
    shared = examples.sparkSession.sparkContext.broadcast(held)
    sizes = {"ngram": n, "substring": 3}

    def keys_of(norm: str, known: dict[str, set]) -> Iterator[tuple[str, str]]:
        if known.get("exact") and (digest := hashlib.md5(norm.encode()).hexdigest()) in known["exact"]:
            yield "exact", digest
        tokens = norm.split()  # a normalised text has no white space but blanks
        for rule, size in sizes.items():
            if known.get(rule):
                for key in known[rule].intersection(map(" ".join, zip(*(tokens[i:] for i in range(size))))):
                    yield rule, key

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [(i, *x) for i, text in enumerate(batch["norm"]) if (norm := text.as_py()) is not None for x in keys_of(norm, known)]
            at, rule, key = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(rule, pa.string()), pa.array(key, pa.string())], names=["id", "rule", "key"])

    own = examples.select("id", normalize_decon(F.col("text")).alias("norm"))
    return own.mapInArrow(of_batches, f"id {dict(examples.dtypes)['id']}, rule string, key string")


def looked_up(examples: DataFrame, index: DataFrame, rules=RULES, n: int = GRAM, most_rows: int | None = None) -> DataFrame:
    """(id, rule, key) of the examples that the index may have, so that what is shuffled is
    about the hits: if the index is small enough to be broadcast those whose key it has,
    else those that a filter of its keys lets through."""
    size = index.count()
    if size <= (BROADCAST_ROWS if most_rows is None else most_rows):
        return _met(examples, index, rules, n)
    own = examples.select("id", F.explode(_keys(normalize_decon(F.col("text")), rules, n)).alias("x")).select("id", "x.rule", "x.key")
    keys = index.select(F.xxhash64("rule", "key").alias("h")).distinct()
    return known(own.withColumn("h", F.xxhash64("rule", "key")), "h", keys, size).drop("h")


def lookups(examples: DataFrame, items: DataFrame, rules=RULES, n: int = GRAM, most_rows: int | None = None) -> DataFrame:
    """id, rule, benchmark, item_index, overlap, keys: the items with which an example
    (id, text) shares keys, stored. One pass over the texts, whatever the rules. An
    index of more than ``most_rows`` rows isn't broadcast."""
    index = stored(indexed(items, rules, n))
    most = BROADCAST_ROWS if most_rows is None else most_rows
    met = looked_up(examples, index, rules, n, most).join(bounded(index, most), ["rule", "key"])
    return stored(met.groupBy("id", "rule", "benchmark", "item_index").agg(F.count(F.lit(1)).alias("overlap"), F.first("keys").alias("keys")))


def _ngrams(found: DataFrame, threshold: float) -> DataFrame:
    hits = found.where((F.col("rule") == "ngram") & (F.col("overlap") / F.col("keys") >= threshold))
    return hits.select("id", "benchmark", "item_index", F.col("keys").cast("int").alias("item_grams"), "overlap")


def ngram_hits(examples: DataFrame, bench: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """id, benchmark, item_index, overlap, item_grams: items whose grams an example
    (id, text) contains to the share ``threshold`` at least.

    An inverted index: gram equals gram, then counts; items of fewer than n words
    have no grams and can't match.
    """
    return _ngrams(lookups(examples, prepared(bench), ("ngram",), n), threshold)


def first_matches(hits: DataFrame) -> DataFrame:
    """Of each example's hits in a benchmark the one with the smallest item index."""
    first = F.min(F.struct("item_index", (F.col("overlap") / F.col("item_grams")).alias("confidence")))
    return hits.groupBy("id", "benchmark").agg(first.alias("f")).select("id", "benchmark", "f.item_index", "f.confidence")


def _exacts(found: DataFrame) -> DataFrame:
    return found.where(F.col("rule") == "exact").groupBy("id", "benchmark").agg(F.min("item_index").alias("item_index"))


def exact_hits(examples: DataFrame, bench: DataFrame) -> DataFrame:
    """id, benchmark, item_index (the least equal item): normalised texts are equal.
    Items without any letter or digit match nothing."""
    return _exacts(lookups(examples, prepared(bench), ("exact",)))


def _contained(examples: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of candidates (id, benchmark, item_index) those whose item the example contains.

    Each candidate text is read once more, and carried once for each of its candidates.
    """
    wanted = stored(candidates.join(bounded(items), ["benchmark", "item_index"]))
    # texts without a candidate go before any is normalised
    met = examples.select("id", "text").join(bounded(wanted), "id")
    return met.where(F.contains(normalize_decon(F.col("text")), F.col("norm"))).select("id", "benchmark", "item_index")


def _short_hits(examples: DataFrame, items: DataFrame) -> DataFrame:
    """id, benchmark, item_index of items too short to be looked up by inner words.

    They are searched for in every text, all at once, with an automaton: in time linear
    in the texts, however many items. An automaton holds as many items as may be
    broadcast; more items take more passes.
    """
    short = items.where(F.size(words(F.col("norm"))) < LOOKED_UP)
    texts = short.select("norm").distinct()
    spark, n = examples.sparkSession, texts.count()
    own = examples.select("id", normalize_decon(F.col("text")).alias("own")).where(F.col("own").isNotNull())
    kind, out = dict(examples.dtypes)["id"], None
    passes = -(-n // BROADCAST_ROWS)
    for i in range(passes):
        part = [r["norm"] for r in texts.where(F.pmod(F.xxhash64("norm"), F.lit(passes)) == i).collect()]
        shared = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = ahocorasick.Automaton()
            for norm in shared.value:
                found.add_word(norm, norm)
            found.make_automaton()
            for batch in batches:
                met = [sorted({norm for _, norm in found.iter(t.as_py())}) for t in batch["own"]]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(met, pa.list_(pa.string()))], names=["id", "norms"])

        met = own.mapInArrow(search, f"id {kind}, norms array<string>").select("id", F.explode("norms").alias("norm"))
        out = met if out is None else out.union(met)
    if out is None:
        return examples.join(items, F.lit(False)).select("id", "benchmark", "item_index")
    return out.join(bounded(short), "norm").select("id", "benchmark", "item_index")


def _substrings(examples: DataFrame, items: DataFrame, found: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """id, benchmark, item_index of contained items, without the pairs (id, benchmark) that are done."""
    candidates = found.where(F.col("rule") == "substring").select("id", "benchmark", "item_index")
    if done is not None:
        candidates = candidates.join(done, ["id", "benchmark"], "left_anti")
    hits = _contained(examples, items, candidates)
    short = _short_hits(examples, items)
    if done is not None:
        short = short.join(done, ["id", "benchmark"], "left_anti")
    return hits.union(short).distinct()


def substring_hits(examples: DataFrame, bench: DataFrame) -> DataFrame:
    """id, benchmark, item_index of items whose normalised text an example contains.

    Words within a contained item, its first and last aside, are whole words of the
    example. So an item of five words or more is looked up by a run of three of
    those, and only candidates are searched; shorter items are searched for
    everywhere, by an automaton. Items without any letter or digit match nothing.
    """
    items = prepared(bench)
    return _substrings(examples, items, lookups(examples, items, ("substring",)))


def evidence(examples: DataFrame, bench: DataFrame, method: str = "hybrid", n: int = GRAM, threshold: float = THRESHOLD, vectors: tuple[DataFrame, DataFrame] | None = None, top_k: int = TOP_K) -> DataFrame:
    """The ladder for each example and benchmark: an exact match ends it, else the first
    n-gram match does, else the first substring match counts.

    ``method`` is exact, ngram, substring, hybrid or embedding. ``vectors``, of the
    examples (id, embedding) and of the items (benchmark, item_index, embedding), give
    evidence of their own: beside the rules if the method is hybrid, instead of them if
    it is embedding. Without vectors, embedding stands for the whole ladder.
    """
    if method not in (*RULES, "hybrid", "embedding"):
        raise ValueError(f"unknown method {method!r}")
    by_vectors = vector_evidence(*vectors, top_k, threshold) if vectors and method in ("hybrid", "embedding") else None
    if method == "embedding" and by_vectors is not None:
        return by_vectors.drop("match_rank")
    rules = (method,) if method in RULES else RULES
    items = prepared(bench)
    looked = lookups(examples, items, rules, n)
    parts, done = [], None
    keys = ["id", "benchmark"]
    if "exact" in rules:
        found = _exacts(looked)
        parts.append(found.select(*keys, "item_index", F.lit("exact").alias("method"), F.lit(1.0).alias("confidence")))
        done = found.select(*keys)
    if "ngram" in rules:
        found = first_matches(_ngrams(looked, threshold))
        found = found if done is None else found.join(done, keys, "left_anti")
        parts.append(found.select(*keys, "item_index", F.lit("ngram").alias("method"), "confidence"))
        done = found.select(*keys) if done is None else done.union(found.select(*keys))
    if "substring" in rules:
        found = _substrings(examples, items, looked, done).groupBy(*keys).agg(F.min("item_index").alias("item_index"))
        parts.append(found.select(*keys, "item_index", F.lit("substring").alias("method"), F.lit(SUBSTRING_CONFIDENCE).alias("confidence")))
    if by_vectors is not None:
        parts.append(by_vectors.drop("match_rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def with_reasons(found: DataFrame, bench: DataFrame) -> DataFrame:
    """Evidence with the item's text, cut to 200 characters, and the reason."""
    reason = F.when(F.col("method") == "exact", "normalized_exact_match").otherwise(F.concat(F.col("method"), F.lit("_match")))
    text = bench.select("benchmark", "item_index", F.substring("text", 1, MATCHED_TEXT).alias("matched_text"))
    return found.join(bounded(text), ["benchmark", "item_index"], "left").withColumn("reason", reason)


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """block, ids, vectors: the rows dealt by hash into blocks of about ``size``."""
    n = rows.count()
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size)))))
    both = F.collect_list(F.struct(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v")))
    return dealt.groupBy("block").agg(both.alias("rows")).select("block", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vectors"))


def vector_top_k(queries: DataFrame, bench: DataFrame, k: int = TOP_K, threshold: float | None = None, others: bool = False, block: int = BLOCK) -> DataFrame:
    """id, item_index, similarity, match_rank of each query's k nearest items.

    Both sides (id, embedding) and (item_index, embedding) have unit vectors. Exact, by
    products of blocks: a task multiplies two blocks and keeps the k best of each
    query, and those are merged, so no row is made for each pair. Of equal
    similarities the higher item index comes first. With ``others`` a query's own
    vector, the item of its id, isn't counted.
    """
    q = _blocks(queries.select("id", "embedding"), "id", block).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    b = _blocks(bench.select("item_index", "embedding"), "item_index", block).select(F.col("ids").alias("b_ids"), F.col("vectors").alias("b"))
    kinds = [dict(df.dtypes)[c] for df, c in ((queries, "id"), (bench, "item_index"))]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, b_ids, b in zip(*(batch[c].to_pylist() for c in ("q_ids", "q", "b_ids", "b"))):
                b_ids = np.asarray(b_ids)
                order = np.argsort(b_ids, kind="stable")[::-1]  # of equals the higher item first
                b_ids, scores = b_ids[order], np.asarray(q, float) @ np.asarray(b, float)[order].T
                if others:
                    scores[np.asarray(q_ids)[:, None] == b_ids[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                at = np.arange(len(q_ids))[:, None]
                kept = np.isfinite(scores[at, best])
                rows = np.broadcast_to(at, best.shape)[kept]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids, batch.schema.field("q_ids").type.value_type).take(pa.array(rows)), pa.array(b_ids[best[kept]]).cast(batch.schema.field("b_ids").type.value_type), pa.array(scores[at, best][kept])], names=["id", "item_index", "similarity"])

    pairs = q.crossJoin(b).mapInArrow(multiply, f"id {kinds[0]}, item_index {kinds[1]}, similarity double")  # of blocks
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), F.desc("item_index")))
    best = pairs.withColumn("match_rank", rank).where(F.col("match_rank") <= k)
    return best if threshold is None else best.where(F.col("similarity") >= threshold)


def vector_evidence(queries: DataFrame, items: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """Evidence by vectors, with match_rank: of each example's k nearest items those whose
    similarity, the confidence, reaches the threshold; rounded to 4."""
    place = F.row_number().over(Window.orderBy("benchmark", "item_index"))  # items are the small side
    known = stored(items.select("benchmark", "item_index", "embedding").withColumn("place", place))
    near = vector_top_k(queries, known.select(F.col("place").alias("item_index"), "embedding"), k, threshold).withColumnRenamed("item_index", "place")
    named = near.join(bounded(known.select("place", "benchmark", "item_index")), "place")
    return named.select("id", "benchmark", "item_index", F.lit("embedding").alias("method"), F.round("similarity", 4).alias("confidence"), "match_rank")


def verdicts(examples: DataFrame, found: DataFrame, hard_fail=HARD_FAIL, review=REVIEW, review_threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """id, verdict, confidence (the highest, rounded to 4), flags, reason_codes for every example.

    block: a hard-fail method, or one benchmark found by several methods; review: a
    review method that is confident enough; else clean. Without evidence: clean, 0.
    """
    per_bench = found.groupBy("id", "benchmark").agg(
        F.count_distinct("method").alias("methods"),
        F.max(F.col("method").isin(*hard_fail)).alias("hard"),
        F.max(F.col("method").isin(*review) & (F.col("confidence") >= review_threshold)).alias("review"),
        F.max("confidence").alias("confidence"),
        F.collect_set(F.concat_ws(":", "benchmark", "method")).alias("codes"),
    )
    per_id = per_bench.groupBy("id").agg(
        F.max(F.col("hard") | (F.col("methods") > 1)).alias("block"),
        F.max("review").alias("review"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("benchmark")).alias("flags"),
        F.array_sort(F.flatten(F.collect_list("codes"))).alias("reason_codes"),
    )
    none = F.array().cast("array<string>")
    return examples.select("id").join(per_id, "id", "left").select(
        "id",
        F.when(F.col("block"), "block").when(F.col("review"), "review").otherwise("clean").alias("verdict"),
        F.coalesce(F.round("confidence", 4), F.lit(0.0)).alias("confidence"),
        F.coalesce("flags", none).alias("flags"),
        F.coalesce("reason_codes", none).alias("reason_codes"),
    )


def without_contaminated(rows: DataFrame) -> DataFrame:
    """Drops blocked rows, and flagged rows without a verdict; review and clean stay."""
    verdict = F.lower(F.coalesce("verdict", F.lit("")))
    return rows.where((verdict != "block") & ~((verdict == "") & (F.size("flags") > 0)))
