"""Cutting lineage, on storage that outlives an executor."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``; a temporary one in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and kept as a table in the shared folder: compressed, and of a size that later plans know."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of what has been settled: they stay until both halves of the driver have collected the
    tables that used them. Listeners are told of a query's end a little later and hold it until then, hence the second round."""
    for pause in (0.5, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
