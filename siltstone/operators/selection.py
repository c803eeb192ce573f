"""Selection: first-wins dedup, keeping the best, and splits with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.rewrite import review, risk
from siltstone.functions.text import pair_key

def with_pair_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pair_key", pair_key(F.col("user"), F.col("assistant")))


def first_of_pairs(rows: DataFrame) -> DataFrame:
    """id of the first row, by id, of each normalised pair. An aggregate, not a window:
    a pair with many copies is combined before the shuffle."""
    return with_pair_key(rows).groupBy("pair_key").agg(F.min("id").alias("id")).select("id")


def new_pairs(candidates: DataFrame, *seen: DataFrame) -> DataFrame:
    """The first rows of each normalised pair that no table of ``seen`` has."""
    fresh = with_pair_key(candidates).groupBy("pair_key").agg(F.min("id").alias("id"))
    for other in seen:
        fresh = fresh.join(with_pair_key(other).select("pair_key").distinct(), "pair_key", "left_anti")
    return candidates.join(fresh.select("id"), "id", "left_semi")


def keep_best(rows: DataFrame, n: int, min_score: float | None = None) -> DataFrame:
    """The n best by score, of equals the first by id; without a judge the first n."""
    if min_score is None:
        return rows.orderBy("id").limit(n)
    return rows.where(F.coalesce("quality_score", F.lit(0.0)) >= min_score).orderBy(F.desc("quality_score"), "id").limit(n)


def split(candidates: DataFrame, selected: DataFrame, min_score: float) -> DataFrame:
    """Adds bucket (accepted or rejected) and rejection_reasons: the row's issues and
    below_min_quality:x.x, distinct and sorted, or not_selected if there are none."""
    marked = candidates.join(selected.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left")
    low = F.when(F.coalesce("quality_score", F.lit(0.0)) < min_score, F.array(F.lit(f"below_min_quality:{min_score:.1f}")))
    none = F.array().cast("array<string>")
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce("quality_issues", none), F.coalesce(low, none))))
    given = F.when(F.col("chosen"), none).when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("not_selected")))
    return marked.withColumn("bucket", F.when(F.col("chosen"), "accepted").otherwise("rejected")).withColumn("rejection_reasons", given).drop("chosen")


def rejection_summary(parts: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent rejection reasons, of equals the one seen first."""
    reasons = parts.where(F.col("bucket") == "rejected").select("id", F.explode("rejection_reasons").alias("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").limit(k)


def riskiest(rows: DataFrame, n: int) -> DataFrame:
    """The n riskiest generated answers not yet reviewed, riskiest and then last first."""
    fit = rows.where((F.col("source") == "generated") & ~F.coalesce("reviewed", F.lit(False)))
    return fit.withColumn("risk", risk(F.col("assistant"))).where("risk > 0").orderBy(F.desc("risk"), F.desc("id")).limit(n)


def curated(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the n riskiest generated answers rewritten and marked as reviewed."""
    chosen = F.broadcast(riskiest(rows, n).select("id").withColumn("hit", F.lit(True)))  # n rows
    out = rows.join(chosen, "id", "left")
    return out.withColumn("assistant", F.when(F.col("hit"), review(F.col("assistant"))).otherwise(F.col("assistant"))).withColumn("reviewed", F.coalesce("reviewed", F.lit(False)) | F.coalesce("hit", F.lit(False))).drop("hit")


def resumed(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """``rows`` with the scores that an earlier run has for the same beginnings (80
    characters each) of user and assistant; the later line wins."""
    key = F.concat_ws("\u0001", F.substring("user", 1, 80), F.substring("assistant", 1, 80))
    index = scored.groupBy(key.alias("resume_key")).agg(F.max_by("quality_score", "id").alias("old_score"))
    return rows.withColumn("resume_key", key).join(index, "resume_key", "left").withColumn("quality_score", F.coalesce("old_score", "quality_score")).drop("resume_key", "old_score")
