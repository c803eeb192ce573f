"""Comparison of a generated set with a reference set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import evaluator_style
from siltstone.functions.text import grams_overlap, pair_key
from siltstone.operators.distribution import counts_by, total_variation
from siltstone.operators.keyfilter import known
from siltstone.operators.quality import topic_counts, with_difficulty
from siltstone.plans.sizes import bounded, stored

NEAR = 0.75
SEMANTIC = 0.88


def pair_keys(rows: DataFrame) -> DataFrame:
    return rows.select("id", pair_key(F.col("user"), F.col("assistant")).alias("k"))


def exact_overlap(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """id of the generated rows whose normalised pair the reference has."""
    return shared_keys(pair_keys(generated), pair_keys(reference)).select("id")


def shared_keys(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """The generated rows whose k the reference has."""
    return generated.join(reference.select("k").distinct(), "k", "left_semi")


LEVELS = (0.95, 0.85)  # likenesses that are looked for before the threshold


def coverable(rows: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """The ``rows`` (id, k, g) of whose grams the filter of the grams of ``others`` knows
    the share ``threshold`` at least: all that can be so alike to one of them, and some
    more. Grams are looked up where they are; a row's number of hits is what is shuffled.
    """
    n = others.agg(F.coalesce(F.sum(F.size("g")), F.lit(0))).first()[0]
    flat = rows.select("id", "k", F.size("g").alias("n"), F.explode("g").alias("gram"))
    hits = known(flat, "gram", others.select(F.explode("g").alias("h")), n).groupBy("id", "k", "n").agg(F.count(F.lit(1)).alias("hits"))
    enough = stored(hits.where(F.col("hits") >= threshold * F.col("n") - 1e-6).select("k").distinct())
    return rows.join(bounded(enough), "k", "left_semi")


def near_overlap(generated: DataFrame, reference: DataFrame, threshold: float = NEAR, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """id, likeness: the best Jaccard of answers' grams with any reference answer, at
    least ``threshold``.

    Grams stand as 64-bit hashes. Answers are compared once for each distinct gram set, so groups of copies don't
    multiply, and sets that both sides have are done. Two sets that are alike enough share
    one of their rarest grams: of n grams the n - ceil(threshold x n) + 1 that the fewest
    answers have. Only sets that share one of those are compared, so passages that very
    many answers have in common bring no candidates as long as answers also have words
    of their own. High likenesses need fewer grams and are looked for first: who has found
    one has found the best, and isn't compared with all that are less alike.

    Two sets that are alike enough share ``threshold`` of either's grams at least, so texts
    with fewer grams that a filter of the other side's knows are done before their grams
    are shuffled: see :func:`coverable`.
    """
    def own(rows: DataFrame) -> DataFrame:
        numbers = F.sort_array(F.array_distinct(F.transform(grams_overlap(F.col("assistant")), lambda x: F.xxhash64(x))))
        return stored(rows.select("id", numbers.alias("g")).withColumn("k", F.concat(F.hex(F.xxhash64("g")), F.hex(F.xxhash64(F.lit("again"), F.col("g"))))))

    def classes(rows: DataFrame) -> DataFrame:
        return stored(rows.where(F.size("g") > 0).groupBy("k").agg(F.any_value("g").alias("g")))

    member, theirs = own(generated), own(reference)
    gen = classes(coverable(member, theirs, threshold))
    ref = classes(coverable(theirs, gen, threshold))
    member = member.select("id", "k")
    grams = gen.select(F.explode("g").alias("gram")).union(ref.select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))

    def by_rarity(side: DataFrame) -> DataFrame:
        """(k, g) with the grams in order, the rarest first."""
        flat = side.select("k", F.explode("g").alias("gram")).join(grams, "gram")
        return stored(flat.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("o")).select("k", F.col("o.gram").alias("g")))

    same = gen.select("k").join(ref.select("k"), "k", "left_semi").withColumn("likeness", F.lit(1.0))
    found = stored(same)
    left, theirs = by_rarity(gen.join(found, "k", "left_anti")), by_rarity(ref)

    def rarest(side: DataFrame, k: str, n: str, level: float) -> DataFrame:
        size = F.size("g")
        return side.select(F.col("k").alias(k), size.alias(n), F.posexplode(F.slice("g", F.lit(1), size - F.ceil(size * level).cast("int") + 1)).alias(f"{k} at", "gram"))

    for level in (*[x for x in levels if x > threshold], threshold):
        shared = rarest(left, "k", "n1", level).join(rarest(theirs, "k2", "n2", level), "gram")
        # what is left behind the places of the shared gram bounds the overlap
        rest = F.least(F.col("n1") - F.col("k at"), F.col("n2") - F.col("k2 at"))
        before = F.least("k at", "k2 at")
        fits = (F.least("n1", "n2") >= level * F.greatest("n1", "n2")) & (rest + before >= level / (1 + level) * (F.col("n1") + F.col("n2")) - 1e-6)
        pairs = shared.where(fits).select("k", "k2").distinct()
        both = pairs.join(left, "k").join(theirs.select(F.col("k").alias("k2"), F.col("g").alias("g2")), "k2")
        likeness = both.withColumn("both", F.size(F.array_intersect("g", "g2"))).select("k", (F.col("both") / (F.size("g") + F.size("g2") - F.col("both"))).alias("likeness"))
        best = stored(likeness.where(F.col("likeness") >= level).groupBy("k").agg(F.max("likeness").alias("likeness")))
        found = found.union(best)
        left = stored(left.join(best, "k", "left_anti"))
    return member.join(found, "k").select("id", "likeness")


def semantic_overlap(generated: DataFrame | None, reference: DataFrame | None, threshold: float = SEMANTIC, others: bool = False, spark=None) -> DataFrame:
    """One row, ``semantic_overlap``: the share of generated vectors whose nearest
    reference vector reaches the threshold; 0 when a side is empty, null where there is
    no model and so no vectors (``spark`` is needed for that)."""
    if generated is None or reference is None:
        return spark.range(1).select(F.lit(None).cast("double").alias("semantic_overlap"))
    from siltstone.operators.decontamination import vector_top_k

    best = vector_top_k(generated, reference, 1, others=others)
    hits = best.agg(F.count_if(F.col("similarity") >= threshold).alias("hits"))
    return generated.agg(F.count(F.lit(1)).alias("n")).join(hits).select((F.col("hits") / F.greatest("n", F.lit(1))).alias("semantic_overlap"))


def topic_overlap(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: shared, new and reference counts of the sides' most frequent topics."""
    g, r = topic_counts(generated).select("topic"), topic_counts(reference).select("topic")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(g.intersect(r), "shared").join(n(g.exceptAll(r), "novel")).join(n(r, "reference")).join(n(g, "generated"))
    return one.select("shared", "novel", (F.col("shared") / F.greatest("reference", F.lit(1))).alias("topic_overlap"), (F.col("novel") / F.greatest("generated", F.lit(1))).alias("topic_novelty"))


def alignment(generated: DataFrame, reference: DataFrame, cluster: str = "topic") -> DataFrame:
    """One row: the distances between the sets and the score that combines them. Each
    text is read once, for a stored row of labels and a digest."""
    def profile(rows: DataFrame) -> DataFrame:
        key = pair_key(F.col("user"), F.col("assistant")).alias("k")
        return stored(with_difficulty(rows).select("id", "topic", F.col(cluster).alias("cluster"), "difficulty", evaluator_style(F.col("assistant")).alias("style"), key))

    generated, reference = profile(generated), profile(reference)
    style = lambda df: counts_by(df, F.col("style"))
    styles = total_variation(style(generated), style(reference)).withColumnRenamed("tvd", "style_distance")
    key = lambda df: counts_by(df, F.coalesce(F.col("cluster"), F.lit("unknown")))
    clusters = total_variation(key(generated), key(reference)).withColumnRenamed("tvd", "cluster_distance")
    level = lambda df: counts_by(df, F.col("difficulty"))
    levels = total_variation(level(generated), level(reference)).withColumnRenamed("tvd", "difficulty_distance")
    exact = generated.agg(F.count(F.lit(1)).alias("n")).join(shared_keys(generated, reference).agg(F.count(F.lit(1)).alias("e"))).select((F.col("e") / F.greatest("n", F.lit(1))).alias("exact_overlap"))
    one = styles.join(clusters).join(levels).join(topic_overlap(generated, reference)).join(exact)
    loss = (
        0.23 * F.col("style_distance")
        + 0.23 * F.col("cluster_distance")
        + 0.18 * F.col("difficulty_distance")
        + 0.18 * (1 - F.col("topic_overlap"))
        + 0.10 * F.col("topic_novelty")
        + 0.08 * F.col("exact_overlap")
    )
    return one.withColumn("alignment_score", 100 * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), loss)))


def validation(internal: DataFrame, aligned: DataFrame, graph: DataFrame) -> DataFrame:
    """One row from match_score, alignment_score and graph_coverage."""
    one = internal.select("match_score").join(aligned.select("alignment_score")).join(graph.select("graph_coverage"))
    score = 0.45 * F.col("match_score") + 0.45 * F.col("alignment_score") + 0.10 * 100 * F.col("graph_coverage")
    return one.withColumn("validated_score", F.round(score, 2)).withColumn("calibration_error", F.round(F.abs(F.col("match_score") - F.col("alignment_score")), 4))


def baseline_deltas(report: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: each metric of a one-row report less the baseline's, rounded to 4."""
    old = baseline.select(*[F.col(m).alias(f"{m}_baseline") for m in metrics])
    return report.join(old).select(*[F.round(F.col(m) - F.col(f"{m}_baseline"), 4).alias(f"{m}_delta") for m in metrics])
