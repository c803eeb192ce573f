"""Quality: rule issues merged with a judge's scores, filters and report metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import difficulty, rule_issues, rule_penalty, score_bucket
from siltstone.functions.text import pair_key, word_count
from siltstone.operators.ranges import running_mean

MIN_SCORE = 7.5
TOP_TOPICS = 20


def scored(examples: DataFrame) -> DataFrame:
    """Adds quality_score and quality_issues from the judge's ``overall`` (null counts as
    5) and ``judge_issues``; issues are distinct and sorted."""
    issues = rule_issues(F.col("user"), F.col("assistant"))
    with_rules = examples.withColumn("rule_issues", issues)
    return with_rules.withColumn("quality_score", F.greatest(F.lit(1.0), F.coalesce("overall", F.lit(5.0)) - rule_penalty(F.col("rule_issues")))).withColumn(
        "quality_issues", F.array_sort(F.array_distinct(F.concat("rule_issues", F.coalesce("judge_issues", F.array().cast("array<string>")))))
    )


def at_least(rows: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    return rows.where(F.coalesce("quality_score", F.lit(0.0)) >= min_score)


def summary(rows: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row: total, passed, failed, average score and lengths in words."""
    s = F.coalesce("quality_score", F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s >= min_score).alias("passed"),
        F.count_if(s < min_score).alias("failed"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg(word_count(F.col("user"))), F.lit(0.0)).alias("avg_user_length"),
        F.coalesce(F.avg(word_count(F.col("assistant"))), F.lit(0.0)).alias("avg_assistant_length"),
    )


def pass_rate(report: DataFrame) -> DataFrame:
    return report.withColumn("pass_rate", F.col("passed") / F.greatest("total", F.lit(1)))


def usable_gate(report: DataFrame, min_average: float = 7.5) -> DataFrame:
    """The checks of a usable dataset, from total, failed, avg_score and hits."""
    checks = {
        "no_failures": F.col("failed") == 0,
        "good_average": F.col("avg_score") >= min_average,
        "no_contamination": F.col("hits") == 0,
        "not_empty": F.col("total") > 0,
    }
    out = report
    usable = F.lit(True)
    for name, check in checks.items():
        out, usable = out.withColumn(name, check), usable & check
    return out.withColumn("usable", usable)


def score_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(score_bucket(F.col("quality_score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def topic_counts(rows: DataFrame, k: int | None = TOP_TOPICS) -> DataFrame:
    """topic, n, first: the k most frequent topics, of equals the one seen first."""
    counts = rows.groupBy(F.coalesce("topic", F.lit("unknown")).alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return counts if k is None else counts.orderBy(F.desc("n"), "first").limit(k)


def with_difficulty(rows: DataFrame) -> DataFrame:
    return rows.withColumn("difficulty", difficulty(F.col("user"), F.col("assistant"), F.col("quality_score")))


def difficulty_counts(rows: DataFrame) -> DataFrame:
    return with_difficulty(rows).groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))


def topic_heatmap(rows: DataFrame) -> DataFrame:
    """topic, easy, medium, hard, zeros included."""
    cells = with_difficulty(rows).groupBy(F.coalesce("topic", F.lit("unknown")).alias("topic"))
    return cells.agg(*[F.count_if(F.col("difficulty") == d).alias(d) for d in ("easy", "medium", "hard")])


def issue_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("quality_issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def count_map(counts: DataFrame, key: str) -> DataFrame:
    """One row, ``counts``: a map from (key, n), a small table, in the order of the keys."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("n").alias("n"))))
    return counts.where(F.col(key).isNotNull()).agg(F.map_from_entries(entries).alias("counts"))


def duplicate_stats(rows: DataFrame) -> DataFrame:
    """groups: equal pairs of normalised texts; members: the rows in them, first ones too."""
    pairs = rows.groupBy(pair_key(F.col("user"), F.col("assistant")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def score_spread(rows: DataFrame) -> DataFrame:
    """One row: the least, highest and average score."""
    s = F.coalesce("quality_score", F.lit(0.0))
    return rows.agg(F.min(s).alias("lowest"), F.max(s).alias("highest"), F.avg(s).alias("average"))


def turn_stats(rows: DataFrame) -> DataFrame:
    """One row: conversations, and the least, highest and average number of their turns (num_turns)."""
    n = F.col("num_turns")
    return rows.agg(F.count(F.lit(1)).alias("conversations"), F.min(n).alias("fewest"), F.max(n).alias("most"), F.avg(n).alias("average"))


def contamination_rollup(verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """kind, name, n: examples by verdict, evidence by method, and by benchmark and method."""
    n = F.count(F.lit(1)).alias("n")
    flagged = found.join(verdicts.where(F.size("flags") > 0).select("id"), "id", "left_semi")
    by = lambda df, kind, name: df.groupBy(name.alias("name")).agg(n).select(F.lit(kind).alias("kind"), "name", "n")
    return (
        by(verdicts, "verdict", F.coalesce("verdict", F.lit("clean")))
        .union(by(flagged, "method", F.col("method")))
        .union(by(flagged, "benchmark_method", F.concat_ws(":", "benchmark", "method")))
    )


def evidence_samples(found: DataFrame, k: int = 10) -> DataFrame:
    """The first k pieces of evidence, by example, then benchmark."""
    return found.orderBy("id", "benchmark", "method", "item_index").limit(k)


def running_average(scores: DataFrame, every: str) -> DataFrame:
    """Cumulative average score in input order within ``every``, as a progress log shows it."""
    return running_mean(scores, "quality_score", every, "id", "average_so_far")
