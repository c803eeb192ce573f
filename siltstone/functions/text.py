"""Text as columns: the three normalisations and their n-grams, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
NONE = "array<string>"


def normalize_decon(text: Column) -> Column:
    """Lower case, trimmed, white space to one space, then punctuation deleted.

    Deletion comes last, so "a - b" keeps two spaces. Null stays null.
    """
    trimmed = F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, SPACES, " "), r"(?U)[^\p{L}\p{N}_\s]", "")


def words(text: Column, parts: int = -1) -> Column:
    """White-space separated words, none for null or blank text; the text is cut into so
    many ``parts`` at most, if given, with the last one whole and an empty one before
    white space at the start."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, parts), lambda w: w != "")


def word_count(text: Column, most: int | None = None) -> Column:
    """How many words; beyond ``most`` some number above it, and the rest isn't read."""
    return F.size(words(text, -1 if most is None else most + 2))


def normalize_pair(text: Column) -> Column:
    """Lower case with single spaces; punctuation stays."""
    return F.array_join(words(F.lower(text)), " ")


def pair_key(user: Column, assistant: Column) -> Column:
    """A digest of the normalised pair: equal pairs are grouped and joined by it, so that
    whole texts aren't shuffled. The first length keeps the sides apart."""
    u, a = normalize_pair(user), normalize_pair(assistant)
    return F.sha2(F.concat(F.length(u).cast("string"), F.lit(" "), u, a), 256)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's argument isn't recomputed
    where the body uses it for every element of another array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """The distinct n-grams of an array of words, none if there are fewer than n."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
        some = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(some)).otherwise(F.array().cast(NONE))

    return bound(tokens, of)


def grams_decon(text: Column, n: int = 5) -> Column:
    return grams(words(normalize_decon(text)), n)


def grams_diversity(text: Column, n: int = 3) -> Column:
    return grams(words(F.lower(text)), n)


def grams_overlap(text: Column, n: int = 3) -> Column:
    """As for diversity, but a short text that isn't blank is one gram as a whole."""

    def of(w: Column) -> Column:
        return F.when(F.size(w).between(1, n - 1), F.array(F.array_join(w, " "))).otherwise(grams(w, n))

    return bound(words(F.lower(text)), of)


def text_hash(text: Column) -> Column:
    return F.md5(normalize_decon(text))


def identifier_slug(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit("general")).otherwise(slug)


def file_slug(text: Column, most: int = 64) -> Column:
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most), "_+$", "")
    return F.when(slug == "", F.lit("dataset")).otherwise(slug)


def label_slug(text: Column) -> Column:
    return F.translate(text, " /", "__")


def domain_key(text: Column) -> Column:
    """Letters and digits of any script in lower case, with one underscore between; else general."""
    key = F.array_join(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), "_")
    return F.when(key == "", F.lit("general")).otherwise(key)


def truncate(text: Column, most: int = 140) -> Column:
    """White space collapsed, and cut to ``most`` characters, the last three being dots."""
    flat = F.array_join(words(text), " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)
