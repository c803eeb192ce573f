"""Mixing sources to target weights.

Every source gets a target number of words: its share of the budget by weight,
at most ``cap`` times its own size, what a capped source cannot use going to the
others by weight (water filling). A source's repetition rate is its target over
its size. A document is emitted floor(rate) times, and once more with a
probability equal to the fraction, drawn from a hash of its id and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, free_names, small, table, text_of, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
SEED = 42


def source_targets(per_source: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    One row per source. Weights repeat over the sources by code point, null last.
    The water level is found by sorted running sums: with sources in the order in
    which they fill up, the level is that of the first source which isn't full
    when all before it are.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    up_to = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("full_at", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        per_source.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("words", F.lit(budget) * F.sum("source_size").over(all_rows))
        .withColumn("full_at", F.col("most") / F.col("weight"))
    )
    levels = (
        ranked.withColumn("used", F.coalesce(F.sum("most").over(up_to), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(onward))
        .withColumn("level", (F.col("words") - F.col("used")) / F.col("left_weight"))
    )
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(all_rows)["level"]
    # a budget beyond all caps has no such source: then every source is full
    return levels.withColumn("water", level).select(
        "source", "source_size", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("water"), F.col("most"))).alias("target")
    )


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def counted(docs: DataFrame, names: list[str], weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``docs``, untouched, with its size, its source's size and target, and its copies
    under four ``names`` that no column has.

    Sizes are counted in words, in whole texts however long. A null or empty text has
    size 0; a null source is a source of its own. Rows without doc_id draw by their
    text; rows that repeat a doc_id draw alike. Sources of size 0 have rate 0. An
    empty table gives an empty result. The per-source table is broadcast if a count
    shows it small; else the join is shuffled, with skewed sources split by AQE.
    """
    size, total, target, copies = names
    of_source, drawn = free_names(docs.select("*", *[F.lit(0).alias(n) for n in names]), "of source", "drawn")
    key = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text|"), F.md5(text_of(docs))))
    base = docs.withColumn(drawn, draw(key, seed)).withColumn(size, word_count(text_of(docs)))
    per_source = base.groupBy(base["source"].alias("source")).agg(F.sum(base[size]).alias("source_size"))
    targets = checkpointed(source_targets(per_source, weights, budget, cap))
    targets = targets.select(F.col("source").alias(of_source), F.col("source_size").alias(total), F.col("target").alias(target))
    joined = base.join(small(targets), base["source"].eqNullSafe(targets[of_source]))
    rate = F.when(joined[total] > 0, joined[target] / joined[total]).otherwise(F.lit(0.0))
    return joined.withColumn(copies, F.floor(rate) + (joined[drawn] < rate - F.floor(rate)).cast("long")).drop(of_source, drawn)


RESULTS = ("size", "source_size", "target", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """:func:`counted` with the results named size, source_size, target and copies (0 or
    more), beside the other columns of ``docs``; its columns of those names are replaced."""
    names = free_names(docs, *RESULTS)
    found = counted(docs, names, **options)
    return found.select(*[found[c] for c in docs.columns if c.lower() not in RESULTS], *[found[c].alias(n) for n, c in zip(RESULTS, names)])


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as the mix takes it.

    Nulls, empty, very long and repeated texts as in :func:`counted`.
    """
    *names, turn = free_names(docs, *RESULTS, "turn")
    found = counted(docs, names, **options)
    return found.withColumn(turn, F.explode(F.array_repeat(F.lit(1), found[names[-1]].cast("int")))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row of ``documents``: doc_id, its size, its source's size and target, and the
    words that the mix takes of it. Null, empty and repeated rows as in :func:`counted`."""
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM {{docs}}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM per),
weighed AS (
  SELECT *, ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[(place - 1) % 3 + 1] AS weight,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM ranked),
levels AS (
  SELECT *, most / weight AS full_at,
         (words - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (SELECT arg_min(level, (full_at, place)) FILTER (WHERE level <= full_at) AS water FROM levels),
targets AS (
  SELECT source, source_size, least(most, coalesce(weight * water, most)) AS target FROM levels, water),
rates AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'text|' || md5(coalesce(text, '')))), 1, 12))::BIGINT
         / {float(1 << 48)}::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""

ORACLE_SQL = (
    ORACLE.format(docs="documents")
    + """
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM rates
"""
)
