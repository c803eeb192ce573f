"""Rule-based labels of a question and its answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import bound, normalize_pair, word_count

# Issue names, in order, and the score each takes away.
PENALTIES = {
    "user_too_short": 0.5,
    "assistant_too_short": 1.5,
    "assistant_too_long": 0.5,
    "answer_copies_prompt": 2.5,
    "placeholder_content": 3.0,
    "weak_answer": 1.5,
}
OTHER_PENALTY = 0.5

# Substrings that mark a style, topic or tone.
PLACEHOLDERS = ("lorem ipsum", "todo", "placeholder")
WEAK = ("i don't know", "cannot help")
STEPS = ("step", "first", "then", "next", "finally")
NUMBERED = ("step 1", "first,", "follow these steps", "1.", "2.")
EMPATHETIC = ("i understand", "i'm sorry", "thanks for", "let me help")
EMPATHY_MARKERS = ("sorry", "understand", "help", "thanks", "i can", "let me")
TOPIC_WORDS = {
    "billing": ("bill", "invoice", "refund", "payment", "subscription", "charge"),
    "account": ("account", "login", "password", "sign in", "reset", "profile"),
    "support": ("support", "help", "issue", "problem", "ticket"),
    "technical": ("api", "error", "bug", "timeout", "install", "configure"),
}


def has_any(text: Column, marks) -> Column:
    """``text`` is computed once for all marks."""
    return bound(text, lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(m)) for m in marks)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rule_issues(user: Column, assistant: Column) -> Column:
    """array<string> of issues, in the fixed order."""

    def of(x: Column) -> Column:
        tests = [
            word_count(user, 3) < 3,
            x["n"] < 12,
            x["n"] > 450,
            stripped(user) == stripped(assistant),
            has_any(x["low"], PLACEHOLDERS),
            has_any(x["low"], WEAK),
        ]
        return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in zip(PENALTIES, tests)]))

    return bound(F.struct(F.lower(assistant).alias("low"), word_count(assistant, 450).alias("n")), of)


def rule_penalty(issues: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    return F.aggregate(issues, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(weights, x), F.lit(OTHER_PENALTY)))


def difficulty(user: Column, assistant: Column, score: Column, given: Column | None = None) -> Column:
    s = F.coalesce(score, F.lit(0.0))

    def of(n: Column) -> Column:
        easy, hard = (n[0] <= 8) & (n[1] <= 40) & (s < 7.5), (n[0] >= 20) | (n[1] >= 120) | (s >= 8.5)
        return F.when(easy, "easy").when(hard, "hard").otherwise("medium")

    inferred = bound(F.array(word_count(user, 20), word_count(assistant, 120)), of)
    if given is None:
        return inferred
    return F.when(F.lower(given).isin("easy", "medium", "hard"), F.lower(given)).otherwise(inferred)


def complexity(user: Column, assistant: Column) -> Column:
    def of(n: Column) -> Column:
        u, a = n[0], n[1]
        return F.when((u + a >= 80) | (u >= 22) | (a >= 55), "hard").when((u + a >= 35) | (u >= 10) | (a >= 24), "medium").otherwise("easy")

    return bound(F.array(word_count(user, 80), word_count(assistant, 80)), of)  # no limit is beyond 80


def planner_style(assistant: Column) -> Column:
    stops = F.length(assistant) - F.length(F.replace(assistant, F.lit("."), F.lit("")))
    return F.when(has_any(F.lower(assistant), STEPS), "procedural").when((word_count(assistant, 50) >= 50) | (stops >= 3), "detailed").otherwise("concise")


def evaluator_style(assistant: Column) -> Column:

    def of(x: Column) -> Column:
        return (
            F.when(has_any(x["low"], NUMBERED), "procedural")
            .when(x["n"] <= 25, "concise")
            .when(has_any(x["low"], EMPATHETIC), "empathetic")
            .when(x["n"] >= 90, "detailed")
            .otherwise("balanced")
        )

    return bound(F.struct(F.lower(assistant).alias("low"), word_count(assistant, 90).alias("n")), of)


def topic(user: Column, assistant: Column, given: Column | None = None, hints: list[str] = (), domain: str = "general") -> Column:
    """The given topic, else the first hint with a word of over 3 letters in the pair's
    text, else the first topic with a keyword there, else the domain."""
    low = F.lower(F.concat_ws(" ", user, assistant))
    options = [] if given is None else [F.when(given != "", given)]
    for hint in hints:
        parts = [w for w in hint.lower().split() if len(w) > 3]
        if parts:
            options.append(F.when(has_any(low, parts), F.lit(hint)))
    options += [F.when(has_any(low, marks), F.lit(name)) for name, marks in TOPIC_WORDS.items()]
    return F.coalesce(*options, F.lit(domain))


def persona(style: Column, level: Column) -> Column:
    return F.when(level == "hard", "expert").when(style == "concise", "beginner").when(style == "detailed", "skeptic").otherwise("general")


def score_bucket(score: Column) -> Column:
    """The label int(s)-int(s)+1, cut towards zero; null counts as 0."""
    low = F.coalesce(score, F.lit(0.0)).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + 1).cast("string"))


def empathy(text: Column) -> Column:
    norm = normalize_pair(text)
    return F.least(F.lit(1.0), sum((F.contains(norm, F.lit(m)).cast("int") for m in EMPATHY_MARKERS), F.lit(0)) / 3.0)


def length_ratio(prediction: Column, reference: Column) -> Column:
    p, r = word_count(prediction), word_count(reference)
    return F.least(p / F.greatest(r, F.lit(1)), r / F.greatest(p, F.lit(1)))


def task_success(f1: Column) -> Column:
    return F.when(f1 >= 0.6, 1.0).when(f1 >= 0.4, 0.5).otherwise(0.0)
