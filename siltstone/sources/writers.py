"""Exports: fine-tuning formats, run artifacts, CSV and JSON reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAREGPT = {"user": "human", "assistant": "gpt", "system": "system"}
NULLS = {"ignoreNullFields": "false"}


def openai(messages: Column, *metadata: Column) -> Column:
    return F.to_json(F.struct(messages.alias("messages"), *metadata), NULLS)


def alpaca(user: Column, assistant: Column) -> Column:
    return F.to_json(F.struct(user.alias("instruction"), F.lit("").alias("input"), assistant.alias("output")))


def sharegpt(messages: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SHAREGPT.items() for x in kv])
    turns = F.transform(messages, lambda m: F.struct(F.coalesce(F.try_element_at(names, m["role"]), m["role"]).alias("from"), m["content"].alias("value")))
    return F.to_json(F.struct(turns.alias("conversations")))


def chatml_text(messages: Column) -> Column:
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(messages, turn), "")


def chatml(messages: Column) -> Column:
    return F.to_json(F.struct(chatml_text(messages).alias("text")))


def chat_text(messages: Column) -> Column:
    """Role: content lines; blank contents are left out."""
    kept = F.filter(messages, lambda m: F.trim(m["content"]) != "")
    return F.array_join(F.transform(kept, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")


def format_lines(rows: DataFrame, kind: str, include_metadata: bool = False) -> DataFrame:
    """ord, value: one JSON text per row, in the format."""
    m = F.col("messages")
    extra = [F.col(c) for c in ("metadata", "quality_score", "flags", "evidence") if include_metadata and c in rows.columns]
    formats = {
        "jsonl": lambda: openai(m, *extra),
        "openai": lambda: openai(m, *extra),
        "huggingface": lambda: openai(m, *extra),
        "alpaca": lambda: alpaca(F.col("user"), F.col("assistant")),
        "sharegpt": lambda: sharegpt(m),
        "chatml": lambda: chatml(m),
    }
    if kind not in formats:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(formats)}")
    return rows.select("ord", formats[kind]().alias("value"))


def export(rows: DataFrame, kind: str, folder: str, name: str, include_metadata: bool = False) -> str:
    """Writes the rows, in order, as text files of one JSON object per line. Alpaca is
    written the same way; ``alpaca_array`` joins a small export to one JSON array."""
    path = f"{folder}/{name.replace(' ', '_').replace('/', '_')}_{kind}"
    format_lines(rows, kind, include_metadata).orderBy("ord").select("value").write.mode("overwrite").text(path)
    return path


def alpaca_array(lines: DataFrame) -> str:
    """A JSON array from (ord, value) lines, streamed to the driver: for small exports."""
    return "[" + ",\n".join(r["value"] for r in lines.orderBy("ord").toLocalIterator()) + "]"


def artifacts(parts: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each bucket that has rows."""
    parts.select("bucket", F.to_json(F.struct(*[c for c in parts.columns if c != "bucket"]), NULLS).alias("value")).write.mode("overwrite").partitionBy("bucket").text(folder)


def csv(rows: DataFrame, folder: str) -> None:
    """CSV with a header; lists are joined with ' | '."""
    lists = {c for c, kind in rows.dtypes if kind == "array<string>"}
    rows.select(*[F.array_join(c, " | ").alias(c) if c in lists else c for c in rows.columns]).write.mode("overwrite").option("header", True).csv(folder)


def report(one_row: DataFrame, path: str, title: str = "Report") -> dict:
    """A one-row result as JSON and Markdown beside each other."""
    found = {k: v for k, v in one_row.first().asDict(recursive=True).items()}
    Path(path).with_suffix(".json").write_text(json.dumps(found, indent=2, default=str, ensure_ascii=False))
    Path(path).with_suffix(".md").write_text(f"# {title}\n\n" + "".join(f"- {k}: {v}\n" for k, v in found.items()))
    return found


def size_category(rows: int) -> str:
    """Labels as the reference gives them: one step below the rows' true class."""
    steps = [(100, "n<1K"), (1_000, "1K<n<10K"), (10_000, "10K<n<100K"), (100_000, "100K<n<1M")]
    return next((label for limit, label in steps if rows < limit), "n>1M")
