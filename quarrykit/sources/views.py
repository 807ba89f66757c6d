"""Canonical views over the star schema: what the mining queries call reviews, ratings, businesses, baskets and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """(u, i, stars, day): each order line is a review of a supplier by a customer."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    stars = (F.lit(1) + F.col("l_quantity").cast("long") % 5).cast("double")
    return joined.select(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("i"), stars.alias("stars"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(u, i, rating): the best review of each user and item."""
    return reviews(spark, d).groupBy("u", "i").agg(F.max("stars").alias("rating"))


def business(spark: SparkSession, d: str, nations: int | None = None) -> DataFrame:
    """(item, city); ``nations`` leaves out suppliers of higher nations, so some reviews have no city."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # nations are a fixed 25 rows
    rows = rows.where(F.col("s_nationkey") < nations) if nations is not None else rows
    return rows.select(F.col("s_suppkey").alias("item"), F.col("n_name").alias("city"))


def order_baskets(spark: SparkSession, d: str) -> DataFrame:
    """(b, i): the distinct brands of each order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("b"), F.col("p_brand").alias("i")).distinct()


def event_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(user, value): the distinct props of each user, both as strings."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("user"), F.col("props").alias("value")).distinct()


def event_sets(spark: SparkSession, d: str) -> DataFrame:
    """(item, element): for each user the distinct days and types of events."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("item"), F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("element")).distinct()


def stream(spark: SparkSession, d: str) -> DataFrame:
    """(ts, event_id, user_id) in the order of the stream."""
    return table(spark, d, "events").select("ts", "event_id", "user_id")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, features)."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("features"))
