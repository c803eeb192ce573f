"""Holdout predictions, uplift, and correlations between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.classify import empathy, length_ratio, task_success
from siltstone.functions.text import normalize_pair, words
from siltstone.operators.ranges import numbered


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the two multisets of words; 0 if a side is empty or nothing is shared.

    Both sides' words are sorted together and passed through once: of each word the
    lesser number of the two sides is shared.
    """
    sided = lambda text, p: F.transform(words(normalize_pair(text)), lambda w: F.struct(w.alias("w"), F.lit(p).alias("p")))

    def state(w: Column, p: Column, r: Column, shared: Column, left: Column, right: Column) -> Column:
        return F.struct(w.alias("w"), p.alias("p"), r.alias("r"), shared.alias("shared"), left.alias("left"), right.alias("right"))

    def step(acc: Column, x: Column) -> Column:
        one, other = x["p"], 1 - x["p"]
        same = acc["w"].eqNullSafe(x["w"])
        done = acc["shared"] + F.when(same, 0).otherwise(F.least(acc["p"], acc["r"]))
        return state(x["w"], one + F.when(same, acc["p"]).otherwise(0), other + F.when(same, acc["r"]).otherwise(0), done, acc["left"] + one, acc["right"] + other)

    def score(acc: Column) -> Column:
        shared = acc["shared"] + F.least(acc["p"], acc["r"])
        return F.when(shared > 0, 2.0 * shared / (acc["left"] + acc["right"])).otherwise(F.lit(0.0))

    zero = F.lit(0)
    return F.aggregate(F.array_sort(F.concat(sided(prediction, 1), sided(reference, 0))), state(F.lit(None).cast("string"), zero, zero, zero, zero, zero), step, score)


def positional(predictions: DataFrame, holdout: DataFrame, order: str = "ord") -> DataFrame:
    """Pairs the rows of two tables by their place in ``order``; the longer one is cut."""

    def placed(df: DataFrame, side: str) -> DataFrame:
        return numbered(df, order, name="place of the row").select(F.col("place of the row").alias("place"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns])

    return placed(predictions, "p").join(placed(holdout, "h"), "place")


def prediction_scores(pairs: DataFrame, prediction: str, reference: str, topic: str) -> DataFrame:
    f1 = token_f1(F.col(prediction), F.col(reference))
    ratio = length_ratio(F.col(prediction), F.col(reference))
    return (
        pairs.withColumn("f1", f1)
        .withColumn("ratio", ratio)
        .withColumn("empathy", empathy(F.col(prediction)))
        .withColumn("success", task_success(F.col("f1")))
        .withColumn("passed", ((F.col("f1") >= 0.45) & (F.col("ratio") >= 0.55)).cast("int"))
        .withColumn("topic", F.coalesce(F.nullif(F.col(topic), F.lit("")), F.lit("unknown")))
    )


def holdout_metrics(scored: DataFrame) -> DataFrame:
    """topic, n and averages, for each topic and for all ('all topics')."""
    metrics = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in ("f1", "ratio", "empathy", "success", "passed")]]
    return scored.groupBy("topic").agg(*metrics).union(scored.agg(F.lit("all topics").alias("topic"), *metrics))


def uplift(base: DataFrame, tuned: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: tuned less base, of one-row metrics on the same holdout."""
    old = base.select(*[F.col(m).alias(f"{m}_base") for m in metrics])
    return tuned.join(old).select(*[F.round(F.col(m) - F.col(f"{m}_base"), 4).alias(f"{m}_uplift") for m in metrics])


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row, n and ``correlation``: null for fewer than two rows or a constant side."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = rows.where(a.isNotNull() & b.isNotNull())
    s = both.agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    defined = (F.col("n") >= 2) & (F.col("sa") > 0) & (F.col("sb") > 0)
    return s.select("n", F.when(defined, F.try_divide(F.col("c"), F.col("sa") * F.col("sb"))).alias("correlation"))


def metric_validation(runs: DataFrame) -> DataFrame:
    """Runs (match, uplift_f1, uplift_success, uplift_passed) to counts, averages and correlations."""
    kept = runs.where(F.col("match").isNotNull() & F.col("uplift_f1").isNotNull())
    out = kept.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.avg("match"), F.lit(0.0)).alias("avg_match"))
    for m in ("uplift_f1", "uplift_success", "uplift_passed"):
        out = out.join(kept.agg(F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}"))).join(correlation(kept, "match", m).select(F.round("correlation", 4).alias(f"corr_{m}")))
    return out
