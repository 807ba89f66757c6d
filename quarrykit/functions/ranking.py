"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def numbered(df: DataFrame, bucket: Column, order: list, name: str = "seq") -> DataFrame:
    """``df`` with the 0-based rank ``name`` of each row in ascending (bucket, order).

    ``bucket`` must never decrease along ``order``. Rows are numbered within their bucket, and the sizes of the buckets
    before are added; only those sizes, a row for each bucket, meet in one task.
    """
    rows = df.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(-(2**62)).cast("long")))
    line = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_b").agg(F.count("*").alias("_n")).select(F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return rows.join(before, F.col("_b") == F.col("_k")).withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_b", "_k", "_r", "_before")


def indexed(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """``df`` with the 0-based rank ``name`` of each row in ascending ``column``, whatever its type: rows are sorted by range,
    so each task numbers a range of its own, and only the ranges' sizes meet."""
    rows = settled(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_m", 33))  # the range; the lower bits count its rows
    line = Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(F.col("_p").alias("_k")).agg(F.count("*").alias("_n")).select("_k", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(before), F.col("_p") == F.col("_k"))  # a row for each range
    return rows.withColumn(name, (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_m", "_p", "_k", "_before")
