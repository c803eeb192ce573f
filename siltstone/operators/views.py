"""Examples: rows of id, ord, user, assistant and what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPLITS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Documents in fewer splits than there are cores, and less than
    SPLITS (a few small files), are dealt out, or one core would do all the work on
    texts; larger inputs are read as they are split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < min(cores, SPLITS) else df


def first_contents(messages) -> tuple:
    """First user and first assistant content of an array of (role, content), else ''."""
    first = lambda role: F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))
    return first("user"), first("assistant")


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, user, assistant: the text of the role's first turn, '' where there is none."""
    first = lambda role: F.coalesce(F.min_by("text", F.when(F.col("role") == role, F.col("turn"))), F.lit(""))
    return conversations.groupBy("conv_id").agg(first("user").alias("user"), first("assistant").alias("assistant"))


def document_examples(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Documents as examples: the text answers its first line; the source is the topic.

    With labels, ``overall`` is the judge's score (9 for good, 6 for bad, 5 unlabelled)
    and ``judge_issues`` has toxic_content where the label says so.
    """
    out = documents.select(
        F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n", 2)[0].alias("user"), F.coalesce("text", F.lit("")).alias("assistant"), F.col("source").alias("topic"), "lang"
    )
    if labels is None:
        return out
    judged = labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    none = F.array().cast("array<string>")
    return (
        out.join(judged, "id", "left")
        .withColumn("overall", F.when(F.col("quality") == 1, 9.0).when(F.col("quality") == 0, 6.0).otherwise(5.0))
        .withColumn("judge_issues", F.when(F.col("toxic") == 1, F.array(F.lit("toxic_content"))).otherwise(none))
        .drop("quality", "toxic")
    )


def benchmark_items(benchmark: DataFrame, groups: int = 5) -> DataFrame:
    """benchmark, item_index, text: the items dealt to several named benchmarks."""
    return benchmark.select(F.concat(F.lit("b"), (F.col("item_id") % groups).cast("string")).alias("benchmark"), F.col("item_id").alias("item_index"), "text")
