"""Counts, rankings and averages over review-style tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_summary(reviews: DataFrame, needle: str, day: str = "day", user: str = "u", item: str = "i") -> DataFrame:
    """One row: reviews, reviews whose date text contains ``needle``, distinct users and items, in one pass."""
    return reviews.agg(
        F.count("*").alias("n_review"),
        F.count_if(F.contains(F.col(day), F.lit(needle))).alias("n_review_like"),
        F.countDistinct(user).alias("n_user"),
        F.countDistinct(item).alias("n_item"),
    )


def count_rows(rows: DataFrame, name: str = "n") -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def distinct_count(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    return rows.agg(F.countDistinct(column).alias(name))


def counts(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


def top_k(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k keys with most rows; ties by key."""
    return counts(rows, key).orderBy(F.desc("n"), key).limit(k)


def bottom_k(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The other end of the same order."""
    return counts(rows, key).orderBy("n", F.desc(key)).limit(k)


def tied_top(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The first k keys, by key, of those that share the largest count. Only the maximum goes round, no ranked list."""
    n = counts(rows, key)
    most = n.agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), F.col("n") == F.col("most")).drop("most").orderBy(key).limit(k)  # one row


def average_by_dimension(facts: DataFrame, dimension: DataFrame, key: str, dim_key: str, group: str, value: str) -> DataFrame:
    """(group, average) with the highest average first, then the group, nulls last. Facts without a dimension row form
    the null group. The average over a dimension row's facts is taken first, so the join sees one row for each key."""
    per_key = facts.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    joined = per_key.join(dimension, per_key[key] == dimension[dim_key], "left")
    averages = joined.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("average"))
    return averages.orderBy(F.desc("average"), F.col(group).asc_nulls_last())


def average_of_two_aggregates(facts: DataFrame, dimension: DataFrame, key: str, dim_key: str, group: str, value: str) -> DataFrame:
    """The same averages as a join of counts with sums, nulls matching nulls."""
    joined = facts.join(dimension, facts[key] == dimension[dim_key], "left")
    n = joined.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    s = joined.groupBy(group).agg(F.sum(value).alias("s"))
    return s.join(n, F.col(group).eqNullSafe(F.col("g"))).select(group, "n", "s", (F.col("s") / F.col("n")).alias("average"))


def partition_profile(rows: DataFrame, key: str, n: int, by: Column | None = None) -> DataFrame:
    """(part, rows) after dealing rows to n partitions by hash of the key, or by the integer expression ``by``."""
    if by is None:
        return rows.repartition(n, key).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"))
    part = F.pmod(by.cast("int"), F.lit(n)).alias("part")
    return rows.select(part).groupBy("part").agg(F.count("*").alias("rows"))


def dealt_by(rows: DataFrame, n: int, by: Column) -> DataFrame:
    """``rows`` in n partitions, row x in partition by(x) mod n exactly: a custom partitioner."""
    return rows.repartitionById(n, F.pmod(by.cast("int"), F.lit(n)))


def first_character(key: str) -> Column:
    """The code of the key's first character, the custom partitioner's hash."""
    return F.ascii(F.substring(F.col(key).cast("string"), 1, 1))


def mode_largest(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, mode): the most frequent value, of several the largest."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", value)).alias(name))


def rmse(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2))).alias("rmse"))


def ranked_in(rows: DataFrame, group: str, order: list, name: str = "r") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
