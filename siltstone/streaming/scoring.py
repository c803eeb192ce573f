"""Incremental scoring of examples: a file stream that resumes from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.quality import scored
from siltstone.plans.effects import Batch, judged
from siltstone.plans.sizes import stored
from siltstone.sources.jsonl import parse_examples, with_ids


def score_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, judge: Batch) -> StreamingQuery:
    """Scores the JSONL files that arrive in ``folder`` and appends to ``out``.

    Each batch writes its own folder, replaced if the batch is run again after a
    failure, so that every line is scored into the output exactly once.
    """
    lines = spark.readStream.text(folder).withColumn("f", F.col("_metadata.file_path"))

    def write(batch: DataFrame, number: int) -> None:
        # a line's place in the batch tells lines apart that repeat; settled, since rows are joined by it
        placed = batch.withColumn("ord", F.struct("f", F.lit(number).alias("b"), F.monotonically_increasing_id().alias("m")))
        rows = stored(with_ids(parse_examples(placed)).drop("metadata", "ord"))
        scored(judged(rows, judge)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(examples: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first of equal pairs within the watermark: dedup state that doesn't grow for ever."""
    from siltstone.functions.text import normalize_pair

    keyed = examples.withWatermark(time, delay).withColumn("pair_key", F.md5(F.concat_ws("\u0001", normalize_pair(F.col("user")), normalize_pair(F.col("assistant")))))
    return keyed.dropDuplicatesWithinWatermark(["pair_key"]).drop("pair_key")
