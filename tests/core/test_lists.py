"""What the fixed lists say of a few texts, spelled out, so that a wrong list is noticed."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import classify

ANSWER = "a plain answer of more than twelve words that stands here for what a person says"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("user", "assistant", "issues", "penalty"), [
    ("How do I do this?", ANSWER, [], 0.0),
    ("Why so", ANSWER, ["user_too_short"], 0.5),
    ("How do I do this?", "too short", ["assistant_too_short"], 1.5),
    ("How do I do this?", "word " * 451, ["assistant_too_long"], 0.5),
    (f" {ANSWER}\n", ANSWER, ["answer_copies_prompt"], 2.5),
    ("How do I do this?", ANSWER + " Lorem Ipsum", ["placeholder_content"], 3.0),
    ("How do I do this?", ANSWER + " TODO", ["placeholder_content"], 3.0),
    ("How do I do this?", ANSWER + " I don't know", ["weak_answer"], 1.5),
    ("Hm", "cannot help", ["user_too_short", "assistant_too_short", "weak_answer"], 3.5),
])
def test_issues(spark, user, assistant, issues, penalty):
    found = classify.rule_issues(F.lit(user), F.lit(assistant))
    assert one(spark, found) == issues and one(spark, classify.rule_penalty(found)) == penalty
    assert one(spark, classify.rule_penalty(F.array(F.lit("another issue")))) == 0.5


@pytest.mark.parametrize(("text", "planner", "evaluator"), [
    ("Press it.", "concise", "concise"),
    ("First, open it. Then shut it.", "procedural", "procedural"),
    ("Next you finally do a step", "procedural", "concise"),
    ("One. Two. Three.", "detailed", "concise"),
    ("word " * 26, "concise", "balanced"),
    ("word " * 90, "detailed", "detailed"),
    ("I understand that " + "word " * 30, "concise", "empathetic"),
    ("Follow these steps " + "word " * 30, "procedural", "procedural"),
    ("Take 2. now " + "word " * 30, "concise", "procedural"),
])
def test_styles(spark, text, planner, evaluator):
    assert one(spark, classify.planner_style(F.lit(text))) == planner and one(spark, classify.evaluator_style(F.lit(text))) == evaluator


@pytest.mark.parametrize(("text", "topic"), [("My invoice is wrong", "billing"), ("I forgot my PASSWORD", "account"), ("open a ticket", "support"), ("the timeout of it", "technical"), ("a refund of the api", "billing"), ("a walk in the park", "general")])
def test_topics(spark, text, topic):
    assert one(spark, classify.topic(F.lit(text), F.lit(""))) == topic


def test_hints_and_given_topics_come_first(spark):
    of = lambda text, given=None, **more: one(spark, classify.topic(F.lit(text), F.lit(""), None if given is None else F.lit(given), **more))
    assert of("about my invoice", "chosen") == "chosen" and of("about my invoice", "") == "billing"
    assert of("about my garden shed", hints=["the shed", "garden tools"]) == "the shed"
    assert of("about my plants", hints=["a an the"], domain="flowers") == "flowers"


def test_levels_personas_and_buckets(spark):
    level = lambda u, a, s: one(spark, classify.difficulty(F.lit("w " * u), F.lit("w " * a), F.lit(s)))
    assert [level(8, 40, 7.4), level(8, 40, 7.5), level(9, 40, 7.0), level(20, 1, 1.0), level(1, 120, 1.0), level(1, 1, 8.5)] == ["easy", "medium", "medium", "hard", "hard", "hard"]
    assert [one(spark, classify.persona(F.lit(s), F.lit(d))) for s, d in (("x", "hard"), ("concise", "easy"), ("detailed", "medium"), ("procedural", "easy"))] == ["expert", "beginner", "skeptic", "general"]
    assert [one(spark, classify.score_bucket(F.lit(s).cast("double"))) for s in (7.9, 0.0, None)] == ["7-8", "0-1", "0-1"]
    assert one(spark, classify.empathy(F.lit("Sorry, I understand. THANKS"))) == 1.0 and one(spark, classify.empathy(F.lit("Let me see"))) == pytest.approx(1 / 3)
