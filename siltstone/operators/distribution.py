"""Distributions over keys: their distance, planned against actual, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACK_CLUSTER = "general__medium__concise"


def counts_by(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def total_variation(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, ``tvd``: half the sum of the differences of shares of (key, n). A key
    on one side has share 0 on the other; an empty side has all shares 0."""
    totals = left.agg(F.sum("n").alias("tl")).join(right.agg(F.sum("n").alias("tr")))
    both = left.select("key", F.col("n").alias("l")).join(right.select("key", F.col("n").alias("r")), "key", "full_outer").na.fill(0, ["l", "r"])
    share = lambda n, t: F.coalesce(F.try_divide(F.col(n), F.col(t)), F.lit(0.0))
    return both.join(F.broadcast(totals)).agg(F.coalesce(F.sum(F.abs(share("l", "tl") - share("r", "tr"))) / 2, F.lit(0.0)).alias("tvd"))


def planned_gaps(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """key, planned, actual, gap for the keys of either side (key, n)."""
    both = planned.select("key", F.col("n").alias("planned")).join(actual.select("key", F.col("n").alias("actual")), "key", "full_outer").na.fill(0, ["planned", "actual"])
    return both.withColumn("gap", F.greatest(F.col("planned") - F.col("actual"), F.lit(0)))


def accepted_by_cluster(rows: DataFrame) -> DataFrame:
    """key, n by cluster_id, else seed_cluster_id, else the general cluster; '' is missing."""
    given = [F.nullif(F.col(c), F.lit("")) for c in ("cluster_id", "seed_cluster_id") if c in rows.columns]
    return counts_by(rows, F.coalesce(*given, F.lit(FALLBACK_CLUSTER)))


def semantic_status(clusters: DataFrame, accepted: DataFrame) -> DataFrame:
    """semantic_cluster, target, generated, gap rolled up from clusters and (key, n)."""
    joined = clusters.join(accepted.select(F.col("key").alias("cluster_id"), "n"), "cluster_id", "left").na.fill(0, ["n"])
    sums = joined.groupBy(F.col("semantic_cluster").cast("string").alias("semantic_cluster")).agg(F.sum("target_examples").alias("target"), F.sum("n").alias("generated"))
    return sums.withColumn("gap", F.greatest(F.col("target") - F.col("generated"), F.lit(0)))


def graph_coverage(clusters: DataFrame, edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row, ``graph_coverage``: the mean over clusters, weighted by target, of
    min(1, 0.8 x own coverage + 0.2 x the best neighbour's similarity x coverage)."""
    covered = (
        clusters.join(accepted.select(F.col("key").alias("cluster_id"), "n"), "cluster_id", "left")
        .na.fill(0, ["n"])
        .select("cluster_id", "target_examples", F.least(F.lit(1.0), F.col("n") / F.greatest("target_examples", F.lit(1))).alias("direct"))
    )
    near = edges.join(covered.select(F.col("cluster_id").alias("dst"), F.col("direct").alias("theirs")), "dst").groupBy(F.col("src").alias("cluster_id")).agg(F.max(F.col("similarity") * F.col("theirs")).alias("near"))
    whole = covered.join(near, "cluster_id", "left").where("target_examples > 0")
    score = F.least(F.lit(1.0), 0.8 * F.col("direct") + 0.2 * F.coalesce("near", F.lit(0.0)))
    return whole.agg(F.round(F.coalesce(F.try_divide(F.sum(score * F.col("target_examples")), F.sum("target_examples")), F.lit(0.0)), 4).alias("graph_coverage"))


def status(clusters: DataFrame, edges: DataFrame, accepted: DataFrame, saturation: float = 1.05) -> DataFrame:
    """One row: divergence, gap ratio, semantic and graph coverage, oversaturated
    clusters, and the match score that combines them; parts are rounded to 4 first."""
    planned = clusters.select(F.col("cluster_id").alias("key"), F.col("target_examples").alias("n"))
    gaps = planned_gaps(planned, accepted).agg(F.sum("gap").alias("gap"), F.sum("planned").alias("planned"))
    over = planned.join(accepted.withColumnRenamed("n", "a"), "key").where(F.col("a") / F.greatest("n", F.lit(1)) > saturation).agg(F.count(F.lit(1)).alias("oversaturated"))
    semantic = semantic_status(clusters, accepted).agg(F.round(F.coalesce(F.try_divide(F.sum(F.least("target", "generated")), F.sum("target")), F.lit(0.0)), 4).alias("semantic_coverage"))
    one = total_variation(planned, accepted).join(gaps).join(semantic).join(graph_coverage(clusters, edges, accepted)).join(over)
    rounded = one.select(
        F.round("tvd", 4).alias("divergence"), F.round(F.coalesce(F.try_divide("gap", "planned"), F.lit(0.0)), 4).alias("gap_ratio"), "semantic_coverage", "graph_coverage", "oversaturated"
    )
    loss = 0.5 * F.col("divergence") + 0.3 * F.col("gap_ratio") + 0.1 * (1 - F.col("semantic_coverage")) + 0.1 * (1 - F.col("graph_coverage"))
    return rounded.withColumn("match_score", F.round(100 * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), loss)), 2))
