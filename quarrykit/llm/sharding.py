"""Shards that all match the corpus's mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their stratum; the i-th of n (from 0) stands at (i + 1/2) / n. Sorted by that
fraction, every stretch of the sequence holds each stratum in proportion, within one row; the sequence is cut into
shards whose counts differ by one at most. Only keys move: ranks are found in hash ranges (``with_rank``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffled_key, with_rank

_RANGES = 4096


def interleaved(rows: DataFrame, stratum: str, key: Column, name: str = "position") -> DataFrame:
    """``rows`` with the 0-based ``name`` of each in the interleaved sequence and ``{name}_of``, the number of rows.

    ``key`` holds 32 hex digits. A null stratum is a stratum. Rows equal in key and fraction are ordered by all their
    columns, so only identical rows can change places.
    """
    columns = rows.columns
    rows = rows.withColumn("_key", key)
    rows = with_rank(rows, [stratum], F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"), ["_key", *columns], "_rank")
    rows = rows.withColumn("_at", (F.col("_rank") + F.lit(0.5)) / F.col("_rank_of"))
    rows = with_rank(rows, [], F.floor(F.col("_at") * _RANGES), ["_at", stratum, "_key", *columns], name)
    return rows.select(*columns, name, f"{name}_of")


def proportional_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", stratum: str = "source", seed: str = "shards", key: str | None = None) -> DataFrame:
    """(id, size, text_crc32, stratum, position, shard, slot) of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16, ``text_crc32`` unsigned; a null text has none and counts as empty.
    ``slot`` numbers a shard's rows from 0 without gaps; shard counts differ by one at most. Rows without an id, with a
    repeated id or without a stratum are dealt like any other. No rows give none. Equal texts are not kept together: a
    group of copies larger than a shard could not be, with equal counts. ``key`` names a column of 32 hex digits that
    orders the rows of a stratum; without it a seeded hash does.
    """
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"), F.col(stratum).alias("stratum"), *([F.col(key).alias("order")] if key else []))
    placed = interleaved(rows, "stratum", F.col("order") if key else shuffled_key(seed, F.col("id"), F.col("text_crc32")))
    placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div position_of as int)"))
    placed = placed.withColumn("slot", F.expr(f"position - (cast(shard as long) * position_of + {shards - 1}) div {shards}"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("stratum").alias(stratum), "position", "shard", "slot")
