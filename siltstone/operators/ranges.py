"""Numbers and running sums over a whole order, without a task that sorts it all.

Rows are dealt by ranges of the order once, in a stored copy (counts and rows of two
exchanges may be cut apart), numbered within their range, and shifted by what the
ranges before hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.plans.sizes import stored

PART = "range of the order"


def dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` by ranges of ``order``, whose number is in PART; stored."""
    return stored(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Adds the row's place in ``order``, from 1. No two rows should tie."""
    parts = dealt(df, *order)
    counts = parts.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.join(F.broadcast(counts.select(PART, before.alias("before"))), PART)
    return placed.withColumn(name, F.row_number().over(Window.partitionBy(PART).orderBy(*order)) + F.col("before")).drop(PART, "before")


def running_mean(df: DataFrame, value: str, every: str, order: str, name: str) -> DataFrame:
    """Adds the mean of ``value`` over the rows of the same ``every`` up to this one in
    ``order``. A frequent key is in many ranges, each of which starts from the sums of
    those before."""
    parts = dealt(df, every, order)
    sums = parts.groupBy(PART, F.col(every).alias("key")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    before = Window.partitionBy("key").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col(PART).alias("part"), "key", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    own = Window.partitionBy(PART, every).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(start, (parts[PART] == start["part"]) & parts[every].eqNullSafe(start["key"]))
    mean = F.try_divide(F.coalesce(F.sum(value).over(own), F.lit(0.0)) + F.col("s0"), F.count(value).over(own) + F.col("n0"))
    return joined.withColumn(name, mean).drop(PART, "part", "key", "s0", "n0")
