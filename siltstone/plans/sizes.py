"""Broadcasts behind a check of their size, and tables that are settled in shared files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``max_rows`` rows at most; else as it is,
    for a shuffled join that AQE can split. The count runs once, at planning: give it a
    table or a :func:`stored` one, which isn't computed again."""
    return F.broadcast(df) if df.count() <= max_rows else df


def with_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, in which no value of ``key`` repeats; raises otherwise."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{key} repeats: {', '.join(str(r[key]) for r in twice)}; give each row one of its own (sources.jsonl.with_ids)")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors share.

    Local sessions without that setting (tests, notebooks) get a temporary one; a
    cluster's executors couldn't share one, so there it is an error.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="spark-checkpoint-")


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the :func:`shared_folder`."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
