"""Ground shared by the operators: the shared folder, lineage cuts, ranks without single tasks."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, as in ``[^\x20\x09-\x0D]+``.
SPACES = "\\x20\\x09-\\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset (tests, one machine) a temporary folder is made; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, sizes are known from here."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of what finished rounds of a loop still hold: shuffle files and broadcast blocks stay until both the Python
    and the JVM half of the driver have collected the tables that used them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def shuffled_key(seed: str, *columns: Column) -> Column:
    """A pseudo-random order, as 32 hex digits, that any engine with md5 reproduces."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary"))


def with_rank(df: DataFrame, groups: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """``df`` with the 0-based rank ``name`` of each row in its group, in ascending (bucket, order), and the group's
    size as ``{name}_of``.

    ``bucket`` has to be an integer that never decreases along ``order``. A group of any size is spread over its
    buckets: rows are numbered inside (group, bucket) and the sizes of the buckets before are added, so no task
    holds a whole group. Null group values form a group.
    """
    keys = [F.struct(F.col(g).alias("v")) for g in groups]  # a struct is never null, so null values join
    df = df.withColumn("_b", bucket).withColumn("_g", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("_g", "_b").agg(F.count("*").alias("_n")).select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_g")).alias(f"{name}_of"))
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_b").orderBy(*order)))
    return numbered.join(sizes, ["_g", "_b"]).withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_g", "_b", "_r", "_before")
