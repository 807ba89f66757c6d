"""Typed readers for review-style inputs. Parameters stand for what programs take on their command line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import numbered


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each line."""
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line, with the declared columns only; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows by position, quotes understood. Every line equal to the header is dropped, not only the first."""
    fields = T._parse_datatype_string(schema).fields
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    names = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
    repeated = F.lit(True)
    for field, name in zip(fields, names, strict=False):
        if isinstance(field.dataType, T.StringType):
            repeated = repeated & F.col(field.name).eqNullSafe(F.lit(name))
    return rows if not any(isinstance(f.dataType, T.StringType) for f in fields) else rows.where(~repeated)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small list as a table with declared types."""
    return spark.createDataFrame(rows, schema)


def points(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, features) from a file without header: id, label, coordinates."""
    fields = F.split(F.col("value"), ",")
    return spark.read.text(path).where("trim(value) <> ''").select(fields[0].alias("id"), fields[1].alias("label"), F.transform(F.slice(fields, 3, F.size(fields) - 2), lambda x: F.rtrim(x).cast("double")).alias("features"))


def batches(stream: DataFrame, size: int, bucket: Column, order: list, skip: int = 0) -> DataFrame:
    """``stream`` as micro-batches of ``size`` rows: columns ``seq`` (from 0) and ``batch``; ``skip`` batches are left out
    at the start, as readers do that look at one batch before their loop. ``bucket`` is a coarse key along ``order``."""
    rows = numbered(stream, bucket, order).withColumn("batch", F.expr(f"seq div {size} - {skip}"))
    return rows.where("batch >= 0")
