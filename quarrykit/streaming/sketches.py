"""Structured Streaming twins of the sketches: the state is a streaming aggregate, so it is spread over the cluster.

Each function starts a query on a stream of (seq, batch, user), runs it over what is there (``availableNow``) and
returns its state as a table; the finishing steps are those of the batch form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.scalar import trailing_zeros
from ..operators import sketch


def _folder(spark: SparkSession) -> str:
    from ..functions.lineage import settled

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        settled(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replay(stream: DataFrame, files: int = 4) -> DataFrame:
    """A table as a stream: written in ``files`` parts along ``seq``, read one part a trigger."""
    spark, path = stream.sparkSession, _folder(stream.sparkSession)
    stream.repartitionByRange(files, "seq").write.parquet(path)
    return spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(query: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query to the end of its input and returns its last state as a table in the shared folder."""
    spark, out = query.sparkSession, _folder(query.sparkSession)

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/state")

    query.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{out}/state")


def bloom(stream: DataFrame, user: str = "user", bits: int = sketch.BITS, n: int = sketch.HASHES) -> DataFrame:
    """(seq, batch, user, false_positive) as ``sketch.bloom``, from two streaming states: first sight of each user and
    first setting of each bit."""
    first = finished(stream.groupBy(user).agg(F.min(F.struct("seq", "batch")).alias("f"))).select(user, "f.seq", "f.batch")
    bit = finished(sketch.hashes(stream, user, bits, n).groupBy("h").agg(F.min("seq").alias("set_at")))
    told = sketch.hashes(first, user, bits, n).join(bit, "h")
    return told.groupBy("seq", "batch", user).agg(F.bool_and(F.col("set_at") < F.col("seq")).alias("false_positive"))


def flajolet_martin(stream: DataFrame, user: str = "user", bits: int = sketch.BITS, n: int = sketch.HASHES) -> DataFrame:
    """(batch, length, estimate) as ``sketch.flajolet_martin``."""
    rows = sketch.hashes(stream, user, bits, n)
    state = finished(rows.groupBy("batch", "j").agg(F.max(trailing_zeros(F.col("h"))).alias("register"), F.count("*").alias("length")))
    power = F.expr("shiftleft(1L, register)")
    return state.groupBy("batch").agg(F.max("length").alias("length"), F.floor(F.avg(power)).alias("estimate"))


def reservoir(stream: DataFrame, size: int, user: str = "user", salt: int = 553) -> DataFrame:
    """(slot, user) at the end of the stream."""
    last = finished(sketch.accepted(stream, size, salt).groupBy("slot").agg(F.max(F.struct("seq", user)).alias("m")))
    return last.select("slot", F.col(f"m.{user}").alias(user))


def windowed_counts(events: DataFrame, ts: str, length: str, late: str, key: str, slide: str | None = None) -> DataFrame:
    """(start, key, n): counts in windows of event time, rows later than ``late`` left out, as a streaming query."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return sketch.event_windows(rows, F.col("_ts"), length, slide, key)


def session_counts(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return sketch.sessions(rows, F.col("_ts"), gap, key)


class Lines(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class LineStreamReader(DataSourceStreamReader):
    """A text file's lines in order; line i belongs to batch i div ``size``. Each batch of lines is a task of its own."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("size", 100))

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        with open(self.path) as f:
            return {"line": sum(1 for _ in f)}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [Lines(i, min(i + self.size, end["line"])) for i in range(start["line"], end["line"], self.size)]

    def read(self, partition: Lines):
        with open(self.path) as f:
            for i, line in enumerate(f):
                if i >= partition.end:
                    return
                if i >= partition.start:
                    yield (i, i // self.size, line.rstrip())

    def commit(self, end: dict) -> None:
        pass


class LineStream(DataSource):
    """``spark.readStream.format("lines").option("path", file).option("size", 100).load()``: (seq, batch, user)."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "seq long, batch long, user string"

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(self.options)


def asked(spark: SparkSession, path: str, size: int) -> DataFrame:
    """The simulated source as a stream."""
    spark.dataSource.register(LineStream)
    return spark.readStream.format("lines").option("path", path).option("size", size).load()


def count_by(stream: DataFrame, key: Column | str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"))
