"""Ranking of models and estimates of run times from small histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.planning import upper_median


def scaled(column: str):
    """Min-max scaling over the whole (small) table; 1 where all values are equal."""
    w = Window.partitionBy()
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise(F.try_divide(F.col(column) - low, high - low))


def ranked_models(results: DataFrame) -> DataFrame:
    """Adds composite (0.5 quality, 0.35 pass rate, 0.15 speed, each scaled) and place to
    the rows whose status is ok."""
    ok = results.where(F.col("status") == "ok")
    parts = ok.withColumn("q", scaled("avg_quality_score")).withColumn("p", scaled("pass_rate")).withColumn("s", scaled("examples_per_second"))
    out = parts.withColumn("composite", F.round(0.5 * F.col("q") + 0.35 * F.col("p") + 0.15 * F.col("s"), 4)).drop("q", "p", "s")
    order = Window.orderBy(F.desc("composite"), F.desc("avg_quality_score"), F.desc("pass_rate"), "model")
    return out.withColumn("place", F.row_number().over(order))


def recommended(recommendations: DataFrame, domain: str) -> DataFrame:
    """The recommendation of the same domain, else that of the most shared words."""
    mine = F.array(*[F.lit(w) for w in domain.lower().split("_")])
    shared = F.size(F.array_intersect(F.split("domain", "_"), mine))
    rank = F.when(F.col("domain") == domain, F.lit(1 << 20)).otherwise(shared)
    return recommendations.withColumn("shared", rank).where("shared > 0").orderBy(F.desc("shared"), "ord").limit(1)


def eta_minutes(history: DataFrame, provider: str, model: str, has_seeds: bool, examples: int, nearest: int = 5) -> DataFrame:
    """One row, low, middle, high: the upper median of the minutes of the nearest
    comparable runs, each scaled to the number of examples."""
    same = history.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("has_seeds") == has_seeds) & (F.col("examples") > 0))
    near = same.orderBy(F.abs(F.col("examples") - examples), F.desc("updated_at")).limit(nearest)
    middle = near.withColumn("scaled", F.col("minutes") * examples / F.col("examples")).agg(upper_median("scaled").alias("middle"))
    return middle.select((F.col("middle") * 0.85).alias("low"), "middle", (F.col("middle") * 1.2).alias("high"))


def rounded_eta(estimate: DataFrame) -> DataFrame:
    """low and high in whole minutes: one at least, and high above low."""
    low = F.greatest(F.lit(1), F.bround("low").cast("long"))
    return estimate.select(low.alias("low"), F.greatest(low + 1, F.bround("high").cast("long")).alias("high"))


def stage_minutes(runs: DataFrame, examples: int) -> DataFrame:
    """stage, minutes: the upper median over comparable runs (examples, stages: map of
    seconds), each scaled to the number of examples; one minute at least."""
    each = runs.select(F.col("examples").alias("n"), F.explode("stages").alias("stage", "seconds"))
    scaled_ = each.withColumn("m", F.col("seconds") / 60.0 * examples / F.greatest("n", F.lit(1)))
    return scaled_.groupBy("stage").agg(F.greatest(F.lit(1), F.bround(upper_median("m")).cast("long")).alias("minutes"))


# Minutes for 100 examples, from and to, where there is no history.
PER_100 = {"70b 72b qwq mixtral": (7.0, 12.0), "32b 34b 27b": (5.0, 9.0), "13b 14b": (3.5, 6.5), "": (2.5, 5.0)}
HOSTED, OTHER = (1.0, 2.5), (1.5, 4.0)


def rough_eta(provider: str, model: str, examples: int, has_seeds: bool) -> tuple[int, int]:
    """Whole minutes, from and to, by the size that a local model's name tells."""
    if provider == "ollama":
        low, high = next(v for marks, v in PER_100.items() if not marks or any(m in model.lower() for m in marks.split()))
    else:
        low, high = HOSTED if provider in ("openai", "anthropic") else OTHER
    share, (down, up) = max(examples, 25) / 100, (1.1, 1.25) if has_seeds else (0.9, 1.0)
    least = max(1, round(low * share * down))
    return least, max(least + 1, round(high * share * up))


def latest(history: DataFrame, n: int = 200) -> DataFrame:
    """The last n rows of a history by time."""
    return history.orderBy(F.desc("updated_at"), F.desc("run")).limit(n)


def candidate_models(available: list[str], recommended_: str | None, n: int, code: bool = False, wanted: list[str] = ()) -> list[str]:
    """Models to compare: those asked for that are there, in that order; else the
    recommended one, then general models before coders (the other way round for
    code), by name."""
    if wanted:
        return [m for m in wanted if m in available]
    order = sorted(available, key=lambda m: (m != recommended_, ("coder" in m) != code, m))
    return order[:n]
