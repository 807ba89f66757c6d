"""Mixing sources to target weights by Pfair scheduling, earliest deadline first.

Each source's rows are shuffled by a seeded hash and cut into blocks. With weight p / q block j (from 1) of a source may
run from slot floor((j - 1) q / p) and must have run by slot ceil(j q / p); one block runs in each slot, of those
released the one with the earliest deadline. On one processor that meets all deadlines, so at any time no source is a
whole block ahead of or behind its weight. When a source is used up its phase ends, and the others go on with their
weights scaled up; every row gets its place, none is dropped or repeated.

Weights are held as exact whole numbers, so the bound holds against the target weights at any length, and every source
has a weight of its own. The driver works out the schedule slot by slot and writes it out in pieces; rows join their
block's slot. A block has ``block`` rows; by default as many that the table makes about ``SLOTS`` blocks (at least
``BLOCK``), so the driver's work is bounded while blocks grow with the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, shuffled_key, with_rank

#: Least rows of a block and the blocks that a table is cut into at most; slots of the schedule that the driver holds at once.
BLOCK, SLOTS, PERIOD = 16, 1 << 22, 1 << 20
_PLAN = "class int, block long, phase int, release long, deadline long, slot long, before long"
_LONGEST = 2**63 - 1


def quantised(weights: list[float], period: int) -> list[int]:
    """Whole numbers of at least 1 with sum ``period``, as near to the weights as largest remainders allow."""
    spare, total = period - len(weights), sum(weights)
    if spare < 0:
        raise ValueError("a period needs a slot for each source")
    exact = [w / total * spare for w in weights]
    out = [1 + int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (int(exact[i]) - exact[i], i))[: period - sum(out)]:
        out[i] += 1
    return out


def windows(j: int, p: int, q: int) -> tuple[int, int]:
    """Release and deadline of block j (from 1) of a source with weight p / q."""
    return (j - 1) * q // p, -(-j * q // p)


def turns(order: Iterator[int], shares: list[int], total: int) -> Iterator[tuple[int, int]]:
    """(source, block from 1) slot by slot, without end, by earliest deadline first. ``order`` gives the sources by falling
    share, ``total`` is the sum of their shares. Only sources that have had a turn cost anything."""
    waiting: list[tuple[int, int, int]] = []
    ready: list[tuple[int, int, int]] = []
    fresh, t = next(order, None), 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(j, shares[i], total)[1], i, j))
        first = None if fresh is None else windows(1, shares[fresh], total)[1]  # released at 0, the earliest of the fresh
        if first is not None and (not ready or first <= ready[0][0]):
            deadline, i, j, fresh = first, fresh, 1, next(order, None)
        else:
            deadline, i, j = heapq.heappop(ready)
        assert t < deadline, "earliest deadline first misses no deadline of a feasible set"
        yield i, j
        heapq.heappush(waiting, (windows(j + 1, shares[i], total)[0], i, j + 1))
        t += 1


def schedule(shares: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one period, by earliest deadline first."""
    order = sorted(range(len(shares)), key=lambda i: (-shares[i], i))
    slots: list[list[int]] = [[] for _ in shares]
    for t, (i, _) in enumerate(islice(turns(iter(order), shares, sum(shares)), sum(shares))):
        slots[i].append(t)
    return slots


def planned(counts: list[int], weights: list[float], block: int = BLOCK) -> Iterator[tuple]:
    """(source, block, phase, release, deadline, slot, rows before) slot by slot until the rows of
    all sources have run; a phase ends with the last block of one source. Sources of weight 0 follow, alike in weight."""
    start = (0, 0, 0)
    for some in ([w if w > 0 else 0 for w in weights], [int(w == 0) for w in weights]):
        for step in _planned([n if w else 0 for n, w in zip(counts, some, strict=True)], some, block, *start):
            yield step
            start = step[2] + 1, step[5] + 1, step[6] + min(block, counts[step[0]] - step[1] * block)


def _planned(counts: list[int], weights: list[float], block: int, phase: int, slot0: int, before: int) -> Iterator[tuple]:
    exact = [Fraction(w) for w in weights]
    unit = lcm(*[x.denominator for x in exact])
    shares = [int(x * unit) for x in exact]
    order = sorted((i for i, n in enumerate(counts) if n), key=lambda i: (-shares[i], i))
    # A linked ring through -1 holds the sources that are left: a used up one goes out in one step.
    after, back = dict(zip([-1, *order], [*order, -1], strict=True)), dict(zip([*order, -1], [-1, *order], strict=True))

    def left() -> Iterator[int]:
        i = after[-1]
        while i != -1:
            yield i
            i = after[i]

    done, total = [0] * len(counts), sum(shares[i] for i in order)
    while after[-1] != -1:
        for t, (i, j) in enumerate(turns(left(), shares, total)):
            release, deadline = windows(j, shares[i], total)
            yield i, done[i], phase, slot0 + release, min(slot0 + deadline, _LONGEST), slot0 + t, before
            before += min(block, counts[i] - done[i] * block)
            done[i] += 1
            if done[i] * block >= counts[i]:
                break
        after[back[i]], back[after[i]] = after[i], back[i]
        phase, slot0, total = phase + 1, slot0 + t + 1, total - shares[i]


def mixed(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int | None = None, period: int = PERIOD, temper: float = 0.5, seed: str = "mix") -> DataFrame:
    """(id, source, block, phase, release, deadline, slot, position) of every row; ``position`` runs from 0, gapless.

    ``weights`` gives target weights by source, those absent get the smallest given; a source of weight 0 comes after all
    others, and a negative weight is an error. Without ``weights`` a source of n rows has weight n ** ``temper``. ``period`` is how many slots the driver plans at a time; it changes no row. A null source is a source. Rows that repeat each other get a place each. No rows give none.
    """
    spark = docs.sparkSession
    tie = F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tie.alias("tie"))
    sizes = docs.groupBy(F.col(source_col).alias("source")).count().orderBy(F.desc("count"), "source").collect()
    names, counts = [r["source"] for r in sizes], [r["count"] for r in sizes]
    block = block or max(BLOCK, -(-sum(counts) // SLOTS))
    if any(w < 0 for w in (weights or {}).values()):
        raise ValueError("a weight is negative")
    least = min((w for w in (weights or {}).values() if w), default=1.0)
    target = [weights.get(n, least) for n in names] if weights else [n**temper for n in counts]
    path, plan, fields = new_folder(spark, "mixture"), planned(counts, target, block), [x.split() for x in _PLAN.split(", ")]
    types = pa.schema([(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in fields])
    piece = list(islice(plan, period))
    while True:
        columns = list(zip(*piece, strict=True)) or [()] * len(fields)
        piece_rows = pa.table([pa.array(c, x.type) for c, x in zip(columns, types, strict=True)], schema=types)
        spark.createDataFrame(piece_rows, _PLAN).write.mode("append").parquet(path)
        if not (piece := list(islice(plan, period))):
            break
    steps = spark.read.schema(_PLAN).parquet(path).withColumnRenamed("class", "c").withColumnRenamed("block", "b")
    classes = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"name {dict(rows.dtypes)['source']}, class int")
    rows = rows.join(F.broadcast(classes), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # a row for each source, which the driver holds too
    rows = rows.withColumn("key", shuffled_key(seed, F.col("id"), F.col("tie")))
    rows = with_rank(rows, ["class"], F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), ["key", "id", "source", "tie"], "rank")
    rows = rows.withColumn("block", F.expr(f"rank div {block}"))
    rows = rows.join(steps, F.expr("class = c and block = b"))
    return rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "phase", "release", "deadline", "slot",
        F.expr(f"before + rank % {block}").alias("position"),
    )
