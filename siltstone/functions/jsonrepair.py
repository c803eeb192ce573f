"""Repair of JSON that a model wrote: the first candidate of a reply that parses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")


def repaired(text: str) -> str:
    """Control characters in strings escaped, commas before a closer dropped, missing
    closers added: squares first, then braces."""
    out, inside, escaped = [], False, False
    depth = {"[": 0, "{": 0}
    for c in text.lstrip("﻿"):
        if inside:
            if not escaped and c == '"':
                inside = False
            if ord(c) < 32:
                c = json.dumps(c)[1:-1]
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            depth[c] += 1
        elif c in "]}":
            depth["[" if c == "]" else "{"] -= 1
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
        out.append(c)
    return "".join(out) + "]" * max(0, depth["["]) + "}" * max(0, depth["{"])


def candidates(raw: str):
    text = FENCE.sub("", raw).strip()
    spans = [text, *(text[text.find(a) : text.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= text.find(a) < text.rfind(b))]
    for span in spans:
        yield span
        yield repaired(span)


def first_json(raw: str | None) -> str | None:
    for option in candidates(raw or ""):
        try:
            return json.dumps(json.loads(option), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repair_json(raw: pd.Series) -> pd.Series:
    """JSON text, null where nothing parses; read it on with try_parse_json."""
    return raw.map(first_json)
