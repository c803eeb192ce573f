"""Chat examples from JSON lines, in four dialects, and raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schema import EVIDENCE, MESSAGE


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def _messages(v: Column) -> Column:
    """The messages of a record: the first dialect whose keys it has."""
    chat = F.filter(
        F.transform(
            F.try_variant_get(v, "$.messages", "array<struct<role:string,content:string>>"),
            lambda m: _message(F.coalesce(m["role"], F.lit("user")), F.coalesce(m["content"], F.lit(""))),
        ),
        lambda m: m["role"].isin("system", "user", "assistant"),
    )
    pair = F.array(_message("user", _text(v, "user")), _message("assistant", _text(v, "assistant")))
    extra = F.coalesce(_text(v, "input"), F.lit(""))
    ask = F.when(extra != "", F.concat(_text(v, "instruction"), F.lit("\n\n"), extra)).otherwise(_text(v, "instruction"))
    instruction = F.array(_message("user", ask), _message("assistant", _text(v, "output")))
    speaker = F.create_map(*[F.lit(x) for x in ("human", "user", "gpt", "assistant", "system", "system")])
    talk = F.transform(
        F.try_variant_get(v, "$.conversations", "array<struct<from:string,value:string>>"),
        lambda m: _message(F.coalesce(F.try_element_at(speaker, F.coalesce(m["from"], F.lit(""))), F.lit("user")), F.coalesce(m["value"], F.lit(""))),
    )
    has = lambda *keys: F.expr("true") if not keys else _all([F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in keys])
    return (
        F.when(has("messages"), chat)
        .when(has("user", "assistant"), pair)
        .when(has("instruction", "output"), instruction)
        .when(has("conversations"), talk)
    )


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def parse_examples(lines: DataFrame, keep_scores: bool = False) -> DataFrame:
    """(ord, value) lines to ord, messages, metadata, and user and assistant texts.

    Blank lines, broken JSON and records with fewer than two messages are dropped. A
    record with messages never falls through to another dialect. With ``keep_scores``
    quality_score, flags and evidence are read too.
    """
    v = F.col("record")
    parsed = lines.where(F.trim("value") != "").withColumn("record", F.try_parse_json("value")).where(v.isNotNull())
    rows = parsed.withColumn("messages", _messages(v)).where(F.size("messages") >= 2)
    first = lambda role: F.coalesce(F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))
    out = [F.col("ord"), F.col("messages").cast(f"array<{MESSAGE}>"), F.try_variant_get(v, "$.metadata", "variant").alias("metadata"), first("user").alias("user"), first("assistant").alias("assistant")]
    if keep_scores:
        out += [
            F.try_variant_get(v, "$.quality_score", "double").alias("quality_score"),
            F.try_variant_get(v, "$.decontamination_flags", "array<string>").alias("flags"),
            F.try_variant_get(v, "$.decontamination_evidence", f"array<{EVIDENCE}>").alias("evidence"),
        ]
    return rows.select(*out)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): lines with a number that increases along each file, files by name."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    return lines.select(F.struct("f", "b", "m").alias("ord"), "value")


def read_examples(spark: SparkSession, path: str, keep_scores: bool = False) -> DataFrame:
    """A JSONL file or folder of examples, in any of the dialects; see parse_examples."""
    return parse_examples(read_lines(spark, path), keep_scores)


def with_ids(rows: DataFrame) -> DataFrame:
    """Adds ``id``, which tells all rows apart (from ``ord``, the line's place), and
    ``content_id``, which equal messages share."""
    place = F.to_json(F.struct("ord"))
    return rows.withColumn("id", F.md5(place)).withColumn("content_id", F.md5(F.to_json(F.struct("messages"))))


def dataset_name(path: str) -> str:
    """A dataset is named after its file, without folder and ending."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def metadata_field(name: str) -> Column:
    return F.try_variant_get("metadata", f"$.{name}", "string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records; a broken line fails the read."""
    return spark.read.option("mode", "FAILFAST").json(path)
