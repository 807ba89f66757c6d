"""Stream sketches in relational form over (seq, batch, user): the same answers a sequential pass would give.

A Bloom filter bit is the first ``seq`` that sets it, so "was it set before" is a comparison; a Flajolet-Martin register
is a maximum; a reservoir slot holds the last element that was accepted for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bytes_modulo, trailing_zeros

#: Bits of the filter and number of hashes.
BITS, HASHES = 69997, 10


def parameters(j: int) -> tuple[int, int]:
    """a and b of hash j, by rule."""
    return 7919 * (j + 1) + 104729, 1299709 * (j + 3)


def hashes(stream: DataFrame, user: str, bits: int, n: int = HASHES, fold: int = BITS) -> DataFrame:
    """``stream`` with a row for each of n hashes: columns j and h in [0, bits)."""
    x = bytes_modulo(F.col(user).cast("string"), fold)
    each = F.array(*[F.struct(F.lit(j).alias("j"), ((F.lit(a).cast("long") * F.col("_x") + b) % bits).alias("h")) for j, (a, b) in ((j, parameters(j)) for j in range(n))])
    rows = stream.withColumn("_x", x)
    return rows.select(*stream.columns, F.explode(each).alias("_e")).select(*stream.columns, "_e.j", "_e.h")


def bloom(stream: DataFrame, user: str = "user", bits: int = BITS, n: int = HASHES) -> DataFrame:
    """(seq, batch, user, false_positive) for the first occurrence of each user: whether the filter, filled by everything
    before, already held it."""
    first = stream.groupBy(user).agg(F.min("seq").alias("seq"), F.min_by("batch", "seq").alias("batch"))
    set_by = hashes(first, user, bits, n)
    bit = set_by.groupBy("h").agg(F.min("seq").alias("set_at"))
    told = set_by.join(bit, "h").groupBy("seq", "batch", user).agg(F.bool_and(F.col("set_at") < F.col("seq")).alias("false_positive"))
    return told


def bloom_rate(stream: DataFrame, user: str = "user", bits: int = BITS, n: int = HASHES) -> DataFrame:
    """(batch, new_users, false_positives, rate) for each batch; 0 where no user is new."""
    batches = stream.select("batch").distinct()
    told = bloom(stream, user, bits, n).groupBy("batch").agg(F.count("*").alias("new_users"), F.count_if("false_positive").alias("false_positives"))
    rows = batches.join(told, "batch", "left").na.fill(0, ["new_users", "false_positives"])
    return rows.withColumn("rate", F.when(F.col("new_users") > 0, F.col("false_positives") / F.col("new_users")).otherwise(F.lit(0.0)))


def registers(stream: DataFrame, user: str = "user", bits: int = BITS, n: int = HASHES) -> DataFrame:
    """(batch, j, register): the most trailing zeros of any of the batch's hashes."""
    return hashes(stream.select("batch", user).distinct(), user, bits, n).groupBy("batch", "j").agg(F.max(trailing_zeros(F.col("h"))).alias("register"))


def flajolet_martin(stream: DataFrame, user: str = "user", bits: int = BITS, n: int = HASHES, groups: int | None = None) -> DataFrame:
    """(batch, length, distinct, estimate): the mean of 2 ** register over the hashes, cut to a whole number; with
    ``groups`` the median of the groups' means instead."""
    power = F.expr("shiftleft(1L, register)")
    regs = registers(stream, user, bits, n)
    if groups:
        means = regs.groupBy("batch", (F.col("j") % groups).alias("g")).agg(F.avg(power).alias("m"))
        estimate = means.groupBy("batch").agg(F.floor(F.median("m")).alias("estimate"))
    else:
        estimate = regs.groupBy("batch").agg(F.floor(F.avg(power)).alias("estimate"))
    truth = stream.groupBy("batch").agg(F.count("*").alias("length"), F.countDistinct(user).alias("distinct"))
    return truth.join(estimate, "batch")


def accepted(stream: DataFrame, size: int, salt: int = 553) -> DataFrame:
    """(seq, batch, user, slot): the elements that enter the reservoir. Element number s (from 1) beyond the first
    ``size`` is taken with chance size / s, to a slot below ``size``; the draws are arithmetic hashes of s."""
    s = F.col("seq") + 1
    draw = (F.col("seq") * 48271 + salt * 7919 + 12345) % 2147483647
    chance = (draw * 16807 % 2147483647) / F.lit(2147483647.0)
    slot = (draw * 69621 % 2147483647) % size
    rows = stream.where((F.col("seq") < size) | (chance < size / s))
    return rows.withColumn("slot", F.when(F.col("seq") < size, F.col("seq")).otherwise(slot).cast("long"))


def reservoir(stream: DataFrame, size: int, slots: list[int] | None = None, user: str = "user", salt: int = 553) -> DataFrame:
    """(batch, slot, user): what each slot holds at the end of each batch; ``slots`` limits the report to some."""
    enter = accepted(stream, size, salt)
    last = enter.groupBy("slot", "batch").agg(F.max_by(user, "seq").alias(user))
    grid = stream.select("batch").distinct().crossJoin(F.broadcast(enter.sparkSession.range(size).select(F.col("id").alias("slot"))))  # `size` rows
    if slots is not None:
        grid = grid.where(F.col("slot").isin(slots))
    rows = grid.join(last, ["batch", "slot"], "left")
    held = F.last(user, ignorenulls=True).over(Window.partitionBy("slot").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("batch", "slot", held.alias(user)).where(F.col(user).isNotNull())


def event_windows(events: DataFrame, ts: Column, length: str, slide: str | None = None, key: str = "event_type") -> DataFrame:
    """(start, key, n): events in tumbling or sliding windows of event time."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: Column, gap: str, key: str) -> DataFrame:
    """(key, start, n): sessions of a key that end after ``gap`` without an event."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
