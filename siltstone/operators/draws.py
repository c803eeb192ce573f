"""Draws of bounded size, by group, in one pass.

A draw is the rows with the least hashes of (seed, id): the same rows however the table is
dealt out, so that a draw can be repeated, and a larger one contains a smaller.
The least of a part of the rows and of another are merged into the least of both: each
task keeps a group's best, and they are merged by group and salt, then by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
HELD = 100_000  # rows that a task holds before it keeps the best of them


def drawn(rows: DataFrame, k: int, group: str | None = None, id: str = "id", seed: int = 42) -> DataFrame:
    """(group, place, id, h) of ``k`` rows of each ``group`` (of the whole table without
    one), place from 1 in the order of their hash, h, of seed and id.

    A group of fewer rows is drawn whole. Null ids aren't drawn; rows that repeat an id
    count once; rows without a group are a group.
    """
    key = F.lit("") if group is None else F.col(group)
    hashed = rows.where(F.col(id).isNotNull()).select(key.alias("group"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string"))).alias("h"), F.col(id).alias("id"))

    def best(table: pa.Table) -> pa.Table:
        """The k least of each group, ties by id; by position, since groups may be null."""
        frame = table.select(["group", "h", "id"]).to_pandas().drop_duplicates().sort_values(["h", "id"], kind="stable")
        kept = frame.groupby("group", dropna=False, sort=False).head(k)
        return table.take(pa.array(kept.index.to_numpy()))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n > HELD:
                table = best(pa.Table.from_batches(held)).combine_chunks()
                if len(table) > HELD // 2:  # very many groups
                    yield from table.to_batches()
                    held, n = [], 0
                else:
                    held, n = table.to_batches(), len(table)
        if n:
            yield from best(pa.Table.from_batches(held)).to_batches()

    schema = ", ".join(f"`{c}` {t}" for c, t in hashed.dtypes)
    parts = hashed.mapInArrow(of_batches, schema).withColumn("salt", F.spark_partition_id() % SALTS)
    least = F.slice(F.array_sort(F.collect_set(F.struct("h", "id"))), 1, k).alias("least")
    merged = parts.groupBy("group", "salt").agg(least)  # a few rows of each task
    merged = merged.select("group", F.explode("least").alias("x")).select("group", "x.*").groupBy("group").agg(least)
    return merged.select("group", F.posexplode("least").alias("at", "x")).select("group", (F.col("at") + 1).alias("place"), "x.id", "x.h")
