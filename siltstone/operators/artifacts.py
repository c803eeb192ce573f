"""Inspection of a run's candidates: summaries, previews and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ranges import numbered


def bucket_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def preview(rows: DataFrame) -> DataFrame:
    """The twelve fields of an artifact's preview: texts trimmed, distinct methods in
    first-seen order, evidence as benchmark:method:confidence, or as the benchmark alone
    where there is no confidence. A field that ``rows`` lacks is null."""
    name = lambda v: F.coalesce(v, F.lit("unknown"))
    one = lambda e: F.when(e["confidence"].isNull(), name(e["benchmark"])).otherwise(F.concat_ws(":", name(e["benchmark"]), name(e["method"]), e["confidence"].cast("string")))
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c in rows.columns else F.array().cast("array<string>").alias(c)
    return rows.select(
        "id",
        given("quality_score"),
        F.trim("user").alias("user"),
        F.trim("assistant").alias("assistant"),
        *[given(c) for c in ("selection_decision", "topic", "persona", "difficulty")],
        listed("rejection_reasons"),
        listed("flags"),
        F.array_distinct(F.transform("evidence", lambda e: name(e["method"]))).alias("methods"),
        F.transform("evidence", one).alias("evidence"),
    )


CSV_LISTS = ("rejection_reasons", "flags", "methods", "evidence")
CSV = ("id", "quality_score", "selection_decision", "topic", "persona", "difficulty", *CSV_LISTS, "user", "assistant")


def csv_rows(rows: DataFrame) -> DataFrame:
    """The twelve columns of the review sheet, lists joined by ' | '; a column that ``rows``
    lacks is empty. ``evidence`` has been summed up as in :func:`preview`."""
    have = {**dict(rows.dtypes)}
    value = lambda c: F.array_join(c, " | ") if c in CSV_LISTS and have[c].startswith("array") else F.col(c)
    return rows.select(*[(value(c) if c in have else F.lit(None).cast("string")).alias(c) for c in CSV])


def inspect_place(rows: DataFrame, by: str) -> DataFrame:
    """Adds place in the inspection order by score (best first, null last), topic or reason."""
    keys = {
        "score": [F.desc_nulls_last("quality_score")],
        "topic": [F.lower(F.coalesce("topic", F.lit("")))],
        "reason": [F.lower(F.array_join("rejection_reasons", ","))],
    }.get(by, [])
    return numbered(rows, *keys, F.asc("id"))
