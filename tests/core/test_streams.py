"""Stateful streams over several triggers and restarts give what a batch over all rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators.selection import first_of_pairs
from siltstone.streaming import stateful

SCHEMA = "id long, user string, assistant string, topic string, quality_score double"


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, f"Question  {rng.randint(0, 9)}", f"Answer {rng.randint(0, 2)}", rng.choice(["a", "b", None]), rng.choice([None, 1.0, 5.5, 9.0])) for i in range(n)]


@pytest.fixture
def arrived(spark, tmp_path):
    """Three folders of files, the rows in random order (late ones come last), some of them twice."""
    all_rows = rows(120, 3)
    all_rows += all_rows[:15]
    random.Random(4).shuffle(all_rows)
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(k):
        spark.createDataFrame(all_rows[k * 45 : (k + 1) * 45], SCHEMA).coalesce(2).write.mode("append").parquet(str(folder))

    return str(folder), all_rows, arrive


def test_first_pairs_over_rounds(spark, tmp_path, arrived):
    folder, all_rows, arrive = arrived
    for k in range(3):  # each a new query from the same checkpoint
        arrive(k)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        assert stateful.run(stateful.first_pairs(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(40), "it ends"
    changes = spark.read.parquet(str(tmp_path / "out"))
    batch = spark.createDataFrame(all_rows, SCHEMA)
    assert {r["id"] for r in stateful.settled(changes).collect()} == {r["id"] for r in first_of_pairs(batch).collect()}
    assert changes.where("replaces is not null").count() > 0
    assert changes.where("id >= replaces").count() == 0


def test_progress_over_rounds(spark, tmp_path, arrived):
    folder, all_rows, arrive = arrived
    for k in range(3):
        arrive(k)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        assert stateful.run(stateful.progress(stream, "topic", ttl_ms=86_400_000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(40), "it ends"
    got = {r["every"]: (r["n"], round(r["average"], 9)) for r in stateful.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    batch = spark.createDataFrame(all_rows, SCHEMA).groupBy(F.coalesce("topic", F.lit("")).alias("t")).agg(F.count("quality_score").alias("n"), F.avg("quality_score").alias("a"))
    assert got == {r["t"]: (r["n"], round(r["a"], 9)) for r in batch.collect()}


def test_distinct_stream_within_its_watermark(spark, tmp_path):
    from siltstone.streaming.scoring import distinct_stream

    schema = "user string, assistant string, at timestamp"
    rows = [("A  question", "an answer", "2024-01-01 10:00:00"), ("a question", "An  answer", "2024-01-01 10:05:00"), ("other", "an answer", "2024-01-01 10:06:00")]
    df = spark.createDataFrame(rows, "user string, assistant string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = distinct_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at")
    stateful.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(40)
    assert sorted(r["user"].lower() for r in spark.read.parquet(str(tmp_path / "out")).collect()) in (["a  question", "other"], ["a question", "other"])
