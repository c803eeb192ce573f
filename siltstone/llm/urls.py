"""URL filters by a cascade of Bloom filters.

The first level holds the listed keys; the second those keys of the corpus that the
first takes for listed though they aren't; the third the listed keys that the second
takes for those; and so on until a level makes no mistake on the corpus's complete
set of keys. The first level that doesn't know a key decides: membership is exact for
every key of the corpus, in a few bits a listed key and without a join.

A rule is a host and the start of a path. The keys of a URL are its host's endings
with its path's beginnings, in the shapes (labels, path length) that rules have.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, table

# The rules of the query, as (verdict, host and start of path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEFAULT = "allow"
BITS_PER_KEY = 12
HASHES = 6
MAX_LEVELS = 40
MAX_BYTES = 64 << 20  # of one cascade, when it is broadcast
PACKED = 1 << 13  # words of a filter that reach the driver as one value


def mixed_up(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that levels hash independently."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """(keys, HASHES) places in a level of ``bits`` bits."""
    turn = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a, b = mixed_up(h1 + turn), mixed_up(h2 ^ turn) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def knows(words: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    at = positions(h1, h2, level, len(words) * 64)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def decide(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that doesn't know it says."""
    listed = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.ones(len(h1), bool)
    for i, words in enumerate(levels):
        passed = knows(words, h1, h2, i)
        listed[open_ & ~passed] = i % 2 == 1
        open_ &= passed
    return listed


def hashed(keys: DataFrame) -> DataFrame:
    """Adds two independent 64-bit hashes of the column ``key``; together they stand for it."""
    return keys.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit("2"), F.col("key")))


def bloom(keys: DataFrame, level: int, bits_per_key: int) -> np.ndarray:
    """One level over ``keys`` (h1, h2), built by the executors and or-ed by Spark."""
    n = keys.count()
    words = max(1, -(-n * bits_per_key // 64))
    if words * 8 > MAX_BYTES:
        raise ValueError(f"a level of {words * 8} bytes; split the list into several cascades")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
            at = positions(h1, h2, level, words * 64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    def packed(of_block: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(PACKED, np.int64)  # its words are distinct
        block[of_block["word"].to_numpy() % PACKED] = of_block["bits"].to_numpy()
        return pd.DataFrame({"block": of_block["word"].iloc[:1] // PACKED, "words": [block.tobytes()]})

    found = keys.select("h1", "h2").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    blocks = found.groupBy((F.col("word") / PACKED).cast("long").alias("at")).applyInPandas(packed, "block long, words binary")
    out = np.zeros(-(-words // PACKED) * PACKED, np.int64)
    for row in blocks.toLocalIterator():  # MAX_BYTES / 64 KB rows at most
        out[row["block"] * PACKED : (row["block"] + 1) * PACKED] = np.frombuffer(row["words"], np.int64)
    return out[:words].view(np.uint64)


def passing(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def known(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(knows(shared.value, h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64), level))

    return keys.where(known("h1", "h2"))


def cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY) -> list[np.ndarray]:
    """The levels for ``listed`` (key) that are exact on ``universe`` (key).

    An empty list gives no level, which knows nothing. The list's size bounds the
    first level, which is checked against MAX_BYTES; each further one holds the
    mistakes of the one before, a few thousandths of the keys.
    """
    ours = checkpointed(hashed(listed.select("key").where(F.col("key").isNotNull()).distinct()))
    if ours.isEmpty():
        return []
    theirs = checkpointed(hashed(universe.select("key").distinct()).join(ours.select("key"), "key", "left_anti"))
    levels, sides = [], [ours, theirs]
    while len(levels) < MAX_LEVELS:
        level = len(levels)
        levels.append(bloom(sides[level % 2], level, bits_per_key))
        other = sides[(level + 1) % 2]
        wrong = checkpointed(passing(other, levels[-1], level))
        if wrong.isEmpty():
            return levels
        sides[(level + 1) % 2] = wrong
    raise RuntimeError(f"mistakes remain after {MAX_LEVELS} levels")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels of host, length of path) of the rules, longest keys first."""
    host = F.regexp_extract("rule", "^[^/]*", 0)
    found = rules.select(F.size(F.split(host, "[.]")).alias("labels"), (F.length("rule") - F.length(host)).alias("path")).distinct().collect()
    return sorted(((r["labels"], r["path"]) for r in found), key=lambda s: (-s[0], -s[1]))


def url_keys(host: Column, path: Column, shaped: list[tuple[int, int]]) -> Column:
    """array<string>: the URL's keys in those shapes that it is long enough for, longest first."""
    keys = [
        F.when(
            (F.size(F.split(host, "[.]")) >= labels) & (F.length(path) >= length) & (host != ""),
            F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)),
        )
        for labels, length in shaped
    ]
    lengths = F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))
    return F.transform(F.array_sort(lengths), lambda x: x["key"])


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url).

    ``rules`` has verdict (allow or block) and rule (host, then the start of a path,
    which begins with a slash). Of the rules that fit, the longest wins; a rule in
    both lists blocks. A URL without a rule is in neither list and gets ``default``.
    A null URL has an empty host and path and no rule; repeated rows are judged
    alike; a very long URL is judged whole; an empty table gives an empty result; other columns aren't read.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = split.withColumn("keys", url_keys(F.col("host"), F.col("path"), shapes(rules)))
    universe = checkpointed(own.select(F.explode("keys").alias("key")).distinct())
    lists = [cascade(rules.where(F.col("verdict") == v).select(F.col("rule").alias("key")), universe) for v in ("allow", "block")]
    if (total := sum(words.nbytes for levels in lists for words in levels)) > 2 * MAX_BYTES:
        raise ValueError(f"cascades of {total} bytes; split the lists")
    shared = spark.sparkContext.broadcast(lists)

    @F.pandas_udf("array<int>")
    def lookup(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = [len(x) for x in h1]
        flat = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64) if len(x) else np.zeros(0, np.uint64) for x in (h1, h2)]
        allow, block = (decide(levels, *flat) if levels else np.zeros(len(flat[0]), bool) for levels in shared.value)
        found = np.where(block, 2, np.where(allow, 1, 0)).astype(np.int32)
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1])) if sizes else pd.Series([], dtype=object)

    places = own.withColumn("in", lookup(F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(F.lit("2"), k))))
    fits = F.filter(F.zip_with("keys", "in", lambda k, i: F.struct(k.alias("key"), i.alias("in"))), lambda x: x["in"] > 0)
    best = F.get(fits, F.lit(0))
    verdict = F.when(best["in"] == 2, F.lit("block")).when(best["in"] == 1, F.lit("allow")).otherwise(F.lit(default))
    return places.select("page_id", "host", "path", best["key"].alias("rule"), verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``. Null, empty, very long
    and repeated URLs as in :func:`judged`."""
    rules = spark.createDataFrame([*RULES], "verdict string, rule string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
rules(verdict, rule) AS (VALUES {", ".join(str(r) for r in RULES)}),
split AS (SELECT verdict, rule, regexp_extract(rule, '^[^/]*') AS rhost, substr(rule, length(regexp_extract(rule, '^[^/]*')) + 1) AS rpath FROM rules),
fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN split
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict
FROM parts LEFT JOIN fits USING (host, path)
"""
