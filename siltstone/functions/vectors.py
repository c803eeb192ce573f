"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length, within [0, 1]; 0 where a side is empty or zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    length = norm(x) * norm(y)
    return F.when((n > 0) & (length > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(x, y), length)))).otherwise(F.lit(0.0))


TOKENS = 24


def first_tokens(text: Column, most: int = TOKENS) -> Column:
    """The first ``most`` of the text's sorted distinct tokens."""
    return F.slice(F.sort_array(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))), 1, most)


def token_lengths(tokens: Column, most: int = TOKENS) -> Column:
    return F.transform(F.slice(F.sort_array(F.array_distinct(tokens)), 1, most), lambda w: F.length(w).cast("double"))


def lexical_vector(text: Column, most: int = TOKENS) -> Column:
    """The lengths of the first sorted distinct tokens: a stand-in where no model is."""
    return token_lengths(first_tokens(text, most), most)
