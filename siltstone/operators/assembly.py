"""Putting datasets together: records from generated pairs, stamps, several turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.rewrite import soften
from siltstone.plans.sizes import bounded


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_records(pairs: DataFrame, system: str | None = None) -> DataFrame:
    """Adds messages to pairs with both sides; others are dropped. A system text comes first."""
    both = pairs.where((F.coalesce("user", F.lit("")) != "") & (F.coalesce("assistant", F.lit("")) != ""))
    turns = [message("user", F.col("user")), message("assistant", F.col("assistant"))]
    return both.withColumn("messages", F.array(*([message("system", F.lit(system))] if system else []), *turns))


def final_dataset(seeds: DataFrame, generated: DataFrame) -> DataFrame:
    """Seeds, then generated rows, stamped with source, seed_example and generation_source."""
    stamp = lambda df, name, seed, place: df.withColumn("source", F.lit(name)).withColumn("seed_example", F.lit(seed)).withColumn("generation_source", F.lit("seed_file" if seed else "synthetic")).withColumn("part", F.lit(place))
    return stamp(seeds, "seed", True, 0).unionByName(stamp(generated, "generated", False, 1), allowMissingColumns=True)


def non_seed_pool(rows: DataFrame) -> DataFrame:
    """Rows that aren't seeds; all rows if there are none."""
    pool = rows.where(~F.coalesce("seed_example", F.lit(False)))
    return rows if pool.isEmpty() else pool


def seeds_of_clusters(plan: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each slot of the plan with the seeds of its cluster, or with all seeds where the
    cluster has none. Seeds are a small table by definition."""
    own = plan.join(seeds, "cluster_id", "left_semi").join(seeds, "cluster_id")
    others = plan.join(seeds, "cluster_id", "left_anti").crossJoin(bounded(seeds.drop("cluster_id")))  # each with all seeds, as asked
    return own.unionByName(others)


def multiturn(rows: DataFrame, most: int) -> DataFrame:
    """Rows (messages, extra: array of (user, assistant)) with up to ``most`` extra pairs
    whose sides aren't blank appended; rows to which nothing is added are dropped."""
    filled = lambda x: (F.trim(F.coalesce(x["user"], F.lit(""))) != "") & (F.trim(F.coalesce(x["assistant"], F.lit(""))) != "")
    good = F.slice(F.filter("extra", filled), 1, most)
    turns = F.flatten(F.transform(good, lambda x: F.array(message("user", x["user"]), message("assistant", x["assistant"]))))
    whole = rows.where(F.size(good) > 0).withColumn("messages", F.concat("messages", turns))
    return whole.withColumn("num_turns", F.floor(F.size("messages") / 2).cast("int")).drop("extra")


def softened(rows: DataFrame) -> DataFrame:
    """Generated answers softened and marked; others stay as they are."""
    generated = (F.col("source") == "generated") & (F.col("assistant") != "")
    return rows.withColumn("assistant", F.when(generated, soften(F.col("assistant"))).otherwise(F.col("assistant"))).withColumn("support_style_sanitized", F.coalesce(generated, F.lit(False)))
