"""Replies of models as typed rows: JSON found, repaired and read, with what is wrong.

A reply is cut into tokens (strings, brackets, commas, the rest) by one expression. What
a model gets wrong most is mended on the tokens: control characters within strings,
commas before a closer, closers that are missing at the end. All of it is columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import bound

TOKEN = r'(?s)"(?:[^"\\]|\\.)*\\?"?|[\[\]{},]|[^"\[\]{},]+'
FENCES = r"^\s*```[A-Za-z]*\s*|\s*```\s*$"
#: Control characters by the escape that stands for each; the others take their number.
ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
ODD = r"[\x00-\x1F]"


def _escaped(token: Column) -> Column:
    out = token
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(ESCAPES.get(code, f"\\u{code:04x}")))
    return out


def _mended(tokens: Column) -> Column:
    strings = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit('"')) & F.regexp_like(t, F.lit(ODD)), _escaped(t)).otherwise(t))

    def shut(parts: Column) -> Column:
        # what stands from one token to the next closer: blanks and commas before it go
        text = F.array_join(F.transform(parts, lambda t: F.when(F.startswith(t, F.lit('"')), F.concat(F.lit("\u0002"), t, F.lit("\u0003"))).otherwise(t)), "")
        tidy = F.regexp_replace(text, r"[\s,]+([\]}])(?=[^\u0002\u0003]*(?:\u0002|$))", "$1")
        count = lambda c: F.size(F.filter(parts, lambda t: t == c))
        missing = lambda a, b: F.greatest(count(a) - count(b), F.lit(0))
        plain = F.regexp_replace(tidy, "[\u0002\u0003]", "")
        return F.concat(plain, F.repeat(F.lit("]"), missing("[", "]")), F.repeat(F.lit("}"), missing("{", "}")))

    return bound(strings, shut)


def repaired(text: Column) -> Column:
    """JSON text with control characters in strings escaped, commas before a closer dropped,
    and closers that are missing added, squares first, then braces."""
    return bound(F.regexp_extract_all(F.regexp_replace(text, "^﻿+", ""), F.lit(TOKEN), F.lit(0)), _mended)


def parsed(reply: Column) -> Column:
    """VARIANT: the first that parses of the reply without fences, what it has between
    braces and what it has between squares, each as it is and repaired; else null."""

    def spans(text: Column) -> Column:
        between = lambda a, b: F.nullif(F.regexp_extract(text, rf"(?s)\{a}.*\{b}", 0), F.lit(""))
        options = [text, between("{", "}"), between("[", "]")]
        return F.coalesce(*[F.try_parse_json(x) for o in options for x in (o, repaired(o))])

    return bound(F.regexp_replace(F.coalesce(reply, F.lit("")), FENCES, ""), spans)


def typed(reply: Column, fields: dict[str, tuple[str, object]]) -> Column:
    """struct of the ``fields`` (name: SQL type and default) of a reply that is an object, and
    ``problem``: null, or why a default stands in: 'no JSON', 'no object', or the
    names that are missing or of another kind."""

    def read(v: Column) -> Column:
        got = {name: F.try_variant_get(v, f"$.{name}", kind) for name, (kind, _) in fields.items()}
        lacking = F.array_join(F.array_compact(F.array(*[F.when(x.isNull(), F.lit(name)) for name, x in got.items()])), ",")
        is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        problem = F.when(v.isNull(), "no JSON").when(~is_object, "no object").when(lacking != "", F.concat(F.lit("missing: "), lacking))
        values = [F.coalesce(x, F.lit(fields[name][1]).cast(fields[name][0])).alias(name) for name, x in got.items()]
        return F.struct(*values, problem.alias("problem"))

    return bound(parsed(reply), read)
