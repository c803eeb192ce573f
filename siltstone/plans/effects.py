"""External work (models) as functions that are handed in, and stubs for tests.

A judge or generator is a callable on a pandas batch, called in tasks with bounded
retries. Store what it returns: a recomputed task would call it again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[pd.DataFrame], pd.DataFrame]


def applied(rows: DataFrame, work: Batch, schema: str, retries: int = 3, wait: float = 0.5, failed: Batch | None = None, batch_size: int | None = None) -> DataFrame:
    """``work`` on every Arrow batch, or on ``batch_size`` rows at a time.

    A batch that keeps failing is tried again row by row, so that a bad row costs no
    other one its result; rows that fail alone give what ``failed`` makes of them, or
    nothing without it. One bad reply can't stop a job or spin forever.
    """

    def attempts(batch: pd.DataFrame) -> pd.DataFrame | None:
        for attempt in range(retries):
            try:
                return work(batch)
            except Exception:
                if attempt + 1 < retries:
                    time.sleep(wait * 2**attempt)
        return None

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            size = batch_size or max(1, len(whole))
            for start in range(0, len(whole), size):
                batch = whole.iloc[start : start + size].reset_index(drop=True)
                if (out := attempts(batch)) is not None:
                    yield out
                    continue
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1].reset_index(drop=True)
                    out = attempts(one) if len(batch) > 1 else None
                    if out is not None:
                        yield out
                    elif failed is not None:
                        yield failed(one)

    return rows.mapInPandas(tried, schema)


def in_waves(slots: Callable[[int, int], DataFrame], work: Batch, schema: str, target: int, folder: str, good: str, most_empty: int = 2, **options) -> DataFrame:
    """What ``work`` makes of slots, wave by wave, until ``target`` good rows are there.

    ``slots(at, n)`` are the n slots after the first ``at`` of a plan that begins anew where it
    ends. A wave asks for what is missing; what it gives is written under ``folder``
    before it is counted, so that each slot is asked for once, and failed rows can be
    read. After ``most_empty`` waves in a row without a good row (``good`` is a condition) it
    gives up: a model that fails for good can't keep a job running.
    """
    have = at = empty = wave = 0
    paths = []
    spark = None
    while have < target and empty < most_empty:
        asked = slots(at, target - have)
        spark = asked.sparkSession
        paths.append(f"{folder}/wave-{wave}")
        applied(asked, work, schema, **options).write.mode("overwrite").parquet(paths[-1])
        n = spark.read.parquet(paths[-1]).where(good).count()
        at, have, wave, empty = at + target - have, have + n, wave + 1, 0 if n else empty + 1
    return spark.read.parquet(*paths) if paths else applied(slots(0, 0), work, schema)


def constant_judge(score: float = 8.0) -> Batch:
    """A judge for tests: the same score for every row, no issues."""

    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["id"], "overall": score, "judge_issues": [[] for _ in range(len(batch))]})

    return judge


#: What a judge may say beside id, overall and judge_issues.
DETAILS = ("relevance", "accuracy", "completeness", "naturalness", "helpfulness")
FLAGS = {"has_pii": "pii_detected", "has_toxic_content": "toxic_content"}


def judged(examples: DataFrame, judge: Batch, batch_size: int | None = None) -> DataFrame:
    """Adds overall, judge_issues and quality_details (the named scores that the reply has).

    A reply that says has_pii or has_toxic_content adds that issue. Rows whose judge
    failed have no score and the issue llm_scoring_failed; of a batch that fails, the
    other rows keep their replies. Store the result: it is read more than once.
    """
    kind = dict(examples.dtypes)["id"]
    more = [*DETAILS, *FLAGS]

    def whole(batch: pd.DataFrame) -> pd.DataFrame:
        reply = judge(batch)
        return reply.reindex(columns=["id", "overall", "judge_issues", *more])

    schema = f"id {kind}, overall double, judge_issues array<string>, {', '.join(f'{c} double' for c in DETAILS)}, {', '.join(f'{c} boolean' for c in FLAGS)}"
    found = applied(examples.select("id", "user", "assistant"), whole, schema, batch_size=batch_size).withColumn("replied", F.lit(True))
    added = F.array_compact(F.array(*[F.when(F.col(c), F.lit(issue)) for c, issue in FLAGS.items()]))
    details = F.map_filter(F.create_map(*[x for c in DETAILS for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    none = F.array().cast("array<string>")
    out = examples.drop("overall", "judge_issues", "quality_details").join(found, "id", "left")
    issues = F.when(F.col("replied"), F.concat(F.coalesce("judge_issues", none), added)).otherwise(F.array(F.lit("llm_scoring_failed")))
    return out.withColumn("judge_issues", issues).withColumn("quality_details", details).drop("replied", *more)


def predicted(holdout: DataFrame, model: Batch, batch_size: int | None = None) -> DataFrame:
    """Adds ``prediction`` to (id, user, assistant): what a model, called with id and user,
    answers (id, prediction); '' where it fails or leaves a row out."""
    kind = dict(holdout.dtypes)["id"]
    blank = lambda one: one[["id"]].assign(prediction="")
    found = applied(holdout.select("id", "user"), model, f"id {kind}, prediction string", failed=blank, batch_size=batch_size)
    return holdout.join(found, "id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def template_writer(text: str = "Answer for {topic} ({persona}, {difficulty}), slot {slot}") -> Batch:
    """A generator for tests: one example per slot, from a template."""

    def write(batch: pd.DataFrame) -> pd.DataFrame:
        rows = batch.to_dict("records")
        return pd.DataFrame({
            "cluster_id": batch["cluster_id"], "topic": batch["topic"], "slot": batch["slot"], "error": None,
            "user": [f"Question {r['slot']} about {r['topic']} for a {r['persona']}?" for r in rows],
            "assistant": [text.format(**r) for r in rows],
        })

    return write
