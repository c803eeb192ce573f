"""Rewrites of support answers that promise too much."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rewrites look for, in order, and what they put there.
_VERBS = "open|issue|arrange|check|investigate|review|update|process|submit|trigger|escalate|flag|create|send|confirm|cancel|refund|ship|unlock|reset"
_DOING = "opening|issuing|arranging|checking|investigating|reviewing|updating|processing|submitting|triggering|escalating|flagging|creating|sending|confirming"
_TIME = r"(\d+\s*(?:hours?|business days?|days?))"
ACTIONS = [
    (rf"\bI(?:'ll| will)\s+({_VERBS})\b", "Support can $1"),
    (rf"\bI(?:'m| am)\s+({_DOING})\b", "The next step is for support to $1"),
    (rf"\bI can\s+({_VERBS}|replace)\b", "Support can $1"),
    (rf"\bWe can\s+({_VERBS}|replace)\b", "Support can $1"),
]
PHRASES = [
    ("right away", "if the request is eligible"),
    ("right now", "next"),
    ("I’ve checked", "Once support checks"),
    ("I've checked", "Once support checks"),
    ("I checked", "Once support checks"),
    ("I can see", "Support should be able to verify"),
    ("we don't make you wait", "the usual next step is"),
]
TIMES = [(rf"\bwithin {_TIME}\b", "typically within $1"), (rf"\bin {_TIME}\b", "typically in $1")]
AWKWARD = [
    ("lose access as the next step", "lose access immediately"),
    ("effective as the next step on our side", "effective once the change is applied on our side"),
    ("effective once the change is applied on our side", "effective once the change is applied"),
    ("typically typically", "typically"),
]
TARGETED = [
    (r"\bLet me\b", "The next step is to"),
    (r"\bI(?:'m| am) going to\b", "The next step is to"),
    (r"\bI(?:'ll| will) check\b", "Support should check"),
    (r"\bI(?:'ll| will) pull\b", "Support should review"),
    (r"\bI(?:'ll| will) investigate\b", "Support should investigate"),
    (r"\bI(?:'ll| will) verify\b", "Support should verify"),
    (r"\bI can try to\b", "Support can try to"),
    (r"\bI can help\b", "Support should help"),
    (r"\bI can initiate\b", "Support can initiate"),
    (r"\bI can request\b", "Support can request"),
    (r"\bI can confirm\b", "Support should confirm"),
    (r"\bI can prioritize\b", "Support can prioritize"),
    # the more specific forms with a curly apostrophe can't match any more after these
    (r"\bI’ll\b", "Support will"),
    (r"\bWe’ll\b", "Support will"),
]
LAST = [
    ("Support will investigate", "Support should investigate"),
    ("Support will verify", "Support should verify"),
    ("Support will check", "Support should check"),
    ("Support will review", "Support should review"),
    ("support will", "support can"),
    ("on our side", "in the support workflow"),
    ("we can’t directly", "support can’t directly"),
    ("we can usually", "support can usually"),
    ("we can still", "support can still"),
    ("we can either", "support can either"),
    ("we can also", "support can also"),
]
RISKS = [
    r"\bI(?:'ll| will)\b",
    r"\bI can\b",
    r"\bSupport can\b",
    r"\bwe(?:'ll| can)\b",
    r"\bescalate\b",
    r"\brefund\b",
    r"\bship\b",
    r"\bon our side\b",
    r"\bwithin \d+",
    r"\btypically within\b",
]


def _patterns(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, "(?i)" + pattern, to)
    return text


def _literals(text: Column, rules) -> Column:
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def soften(text: Column) -> Column:
    return _literals(_patterns(_literals(_patterns(text, ACTIONS), PHRASES), TIMES), AWKWARD)


def review(text: Column) -> Column:
    """The stronger rewrite, for the riskiest answers."""
    return _literals(_patterns(soften(text), TARGETED), LAST)


def risk(text: Column) -> Column:
    """The number of matches of all risk patterns; overlapping ideas count twice."""
    return sum((F.regexp_count(text, F.lit("(?i)" + p)) for p in RISKS), F.lit(0))
