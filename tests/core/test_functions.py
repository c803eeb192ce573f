import pytest
from pyspark.sql import functions as F

from siltstone.functions import classify, jsonrepair, rewrite, text, vectors


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_punctuation_goes_after_spaces(spark):
    assert one(spark, text.normalize_decon(F.col("x")), x=" A - b, Größe!\n") == "a  b größe"


@pytest.mark.parametrize("x,n", [("", 0), ("  ", 0), ("a\tb c \n d", 4)])
def test_words(spark, x, n):
    assert one(spark, text.word_count(F.col("x")), x=x) == n


def test_short_texts_have_grams_only_for_overlap(spark):
    assert one(spark, text.grams_decon(F.col("x")), x="four words are here") == []
    assert one(spark, text.grams_diversity(F.col("x")), x="two words") == []
    assert one(spark, text.grams_overlap(F.col("x")), x="Two  words") == ["two words"]
    assert one(spark, text.grams_overlap(F.col("x")), x=" ") == []
    assert one(spark, text.grams_diversity(F.col("x")), x="a b a b a") == ["a b a", "b a b"]


def test_slugs(spark):
    assert one(spark, text.identifier_slug(F.col("x")), x="Billing & Refunds!") == "billing_refunds"
    assert one(spark, text.identifier_slug(F.col("x")), x="--") == "general"
    assert one(spark, text.file_slug(F.col("x")), x="..") == "dataset"
    assert one(spark, text.label_slug(F.col("x")), x="a b/c") == "a_b_c"
    assert one(spark, text.truncate(F.col("x"), 10), x="abcdef  ghijkl") == "abcdef ..."


def test_rule_issues_in_order(spark):
    issues = classify.rule_issues(F.col("u"), F.col("a"))
    assert one(spark, issues, u="Hi", a="Hi ") == ["user_too_short", "assistant_too_short", "answer_copies_prompt"]
    assert one(spark, issues, u="What is a mastodon really", a="word " * 12 + "mastodon") == ["placeholder_content"]
    assert one(spark, issues, u="one two three", a="I don't know " + "word " * 450) == ["assistant_too_long", "weak_answer"]
    assert one(spark, classify.rule_penalty(F.array(F.lit("placeholder_content"), F.lit("other")))) == 3.5


@pytest.mark.parametrize("score,given,want", [(None, None, "easy"), (8.0, None, "medium"), (8.5, None, "hard"), (9.0, "EASY", "easy"), (9.0, "odd", "hard")])
def test_difficulty(spark, score, given, want):
    assert one(spark, classify.difficulty(F.lit("a b"), F.lit("c d"), F.lit(score).cast("double"), F.lit(given).cast("string"))) == want


def test_styles_differ_on_purpose(spark):
    a = "Authentication is done by us."
    assert one(spark, classify.planner_style(F.col("a")), a=a) == "procedural"
    assert one(spark, classify.evaluator_style(F.col("a")), a=a) == "concise"
    assert one(spark, classify.topic(F.lit("my bill"), F.lit("ok"), hints=["Order status"])) == "billing"
    assert one(spark, classify.topic(F.lit("my order"), F.lit("ok"), hints=["Order status"])) == "Order status"
    assert one(spark, classify.score_bucket(F.lit(7.9))) == "7-8"


def test_softening_and_review(spark):
    assert one(spark, rewrite.soften(F.col("x")), x="I'll check this right away, within 24 hours.") == "Support can check this if the request is eligible, typically within 24 hours."
    assert one(spark, rewrite.soften(F.col("x")), x="I am reviewing it") == "The next step is for support to reviewing it"
    assert one(spark, rewrite.review(F.col("x")), x="Let me help. I’ll check on our side.") == "The next step is to help. Support should check in the support workflow."
    assert one(spark, rewrite.risk(F.col("x")), x="I can refund it within 3 days, we can ship.") == 5


def test_vectors(spark):
    v = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, vectors.clamped_cosine(v(1, 0, 5), v(1, 0))) == 1.0
    assert one(spark, vectors.clamped_cosine(v(-1, 0), v(1, 0))) == 0.0
    assert one(spark, vectors.clamped_cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, vectors.lexical_vector(F.lit("b aaa b, Ünï"))) == [3.0, 1.0, 3.0]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('text {"a": [1, 2,],} more', '{"a": [1, 2]}'),
        ('{"a": "x\ny"}', '{"a": "x\\ny"}'),
        ('{"a": [1, {"b": 2', None),
        ('{"a": [1, 2', '{"a": [1, 2]}'),
        ("nothing", None),
        (None, None),
    ],
)
def test_json_repair(raw, want):
    assert jsonrepair.first_json(raw) == want
