"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it, for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors share.

    Local sessions without that setting (tests, notebooks) get a temporary one; a
    cluster's executors couldn't share one, so there it is an error.
    """
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in files under :func:`shared_folder`.

    Spark deletes them once they aren't referred to any more if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``max_rows`` rows, else
    without one: the join is then shuffled, and AQE splits its skewed partitions.

    Call it on a checkpointed table, so that the count reads a file.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as make them differ from all columns."""
    taken, mark = {c.lower() for c in df.columns}, ""
    while taken & {f"{mark}{n}".lower() for n in names}:
        mark += "_"
    return [f"{mark}{n}" for n in names]


def text_of(docs: DataFrame) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
