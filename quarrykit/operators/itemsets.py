"""Frequent itemsets on exploded baskets (b, i): level-wise, in two passes over chunks, and with hashed pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from .similarity import kinds_of_members, numbered_members


def supports(baskets: DataFrame, column: str = "i") -> DataFrame:
    """(item, support): rows for each item."""
    return baskets.groupBy(column).agg(F.count("*").alias("support"))


def as_sets(baskets: DataFrame, key: str = "b", item: str = "i", larger_than: int = 0) -> DataFrame:
    """(key, items): each basket as a sorted array, of those with more than ``larger_than`` items."""
    sets = baskets.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.where(F.size("items") > larger_than)


def date_customer_baskets(rows: DataFrame, day: Column, customer: Column, item: Column, larger_than: int = 0) -> DataFrame:
    """(b, items): the distinct items of each day and customer, of those with more than ``larger_than`` items."""
    return as_sets(rows.select(F.concat_ws("-", day, customer).alias("b"), item.alias("i")), larger_than=larger_than)


def threshold(baskets: DataFrame, share: float) -> int:
    """The support that a share of the baskets amounts to."""
    n = baskets.select("b").distinct().count()
    return max(1, -(-int(share * n * 1_000_000) // 1_000_000))


def frequent(baskets: DataFrame, support: int, most: int | None = None, chunk: str | None = None, chunk_support: DataFrame | None = None) -> DataFrame:
    """(items, support) of all itemsets in at least ``support`` baskets, sizes 1 to ``most`` (all if None).

    Level k + 1 joins the occurrences of frequent k-sets with the basket's larger frequent items, so every count is
    exact and infrequent sets never grow. With ``chunk`` itemsets are counted in each chunk against the support that
    ``chunk_support`` (chunk, need) gives it; the result is (chunk, items, support). The driver only learns whether a
    level is empty.
    """
    group = [chunk] if chunk else []

    def enough(counted: DataFrame) -> DataFrame:
        if not chunk:
            return counted.where(F.col("support") >= support)
        return counted.join(F.broadcast(chunk_support), chunk).where(F.col("support") >= F.col("need")).drop("need")  # a row for each chunk

    rows = baskets.select(*group, "b", "i").distinct()
    level = settled(enough(rows.groupBy(*group, "i").agg(F.count("*").alias("support"))))
    rows = settled(rows.join(level.drop("support"), [*group, "i"], "left_semi"))
    out = [level.select(*group, F.array("i").alias("items"), "support")]
    found = rows.select(*group, "b", F.array("i").alias("items"), F.col("i").alias("last"))
    k = 1
    while (most is None or k < most) and not level.isEmpty():
        k += 1
        more = found.join(rows, [*group, "b"]).where("i > last").select(*group, "b", F.concat("items", F.array("i")).alias("items"), F.col("i").alias("last"))
        level = settled(enough(more.groupBy(*group, "items").agg(F.count("*").alias("support"))))
        out.append(level)
        found = settled(more.join(level.drop("support"), [*group, "items"], "left_semi"))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


#: Numbers that a task can lay out as zeros and ones; prefixes that it takes at a time, and sets that it compares with others at a time.
_CELLS, _AT_A_TIME, _ROWS = 1 << 25, 64, 1024


def _larger(own: np.ndarray, need: int) -> Iterator[tuple[list[int], int]]:
    """Positions of two or more rows of ``own`` (zeros and ones) that share ``need`` columns at least, in rising order, and how many."""
    for p in range(0, len(own), _ROWS):
        common = own[p : p + _ROWS] @ own[p:].T
        i, j = np.divmod(np.flatnonzero(common >= need), common.shape[1])
        i, j, n = i[i < j], j[i < j], common[i[i < j], j[i < j]]
        yield from (([a, b], c) for a, b, c in zip((i + p).tolist(), (j + p).tolist(), n.astype(np.int64).tolist()))
        for a in np.flatnonzero(np.bincount(i) > 1) if len(i) else ():
            after = j[i == a] + p
            for some, c in _larger(own[after] * own[a + p], need):
                yield [int(a) + p, *after[some].tolist()], c


def _tasks_sets(support: int):
    """(items, support) of all frequent sets of two or more items whose first item, in the order of their baskets' number, is the task's."""

    def told(at: list[np.ndarray], ids: pa.Array, counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([np.full(len(x), x.shape[1]) for x in at])
        flat = np.concatenate([np.sort(x, axis=1).ravel() for x in at])
        items = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), ids.take(pa.array(flat)))
        yield pa.RecordBatch.from_arrays([items, pa.array(np.concatenate(counts))], ["items", "support"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by("item").combine_chunks()
        ids, n = rows.column("item").combine_chunks(), rows.column("n").to_numpy()
        flat = pc.list_flatten(rows.column("members")).to_numpy()
        task, tasks = rows.column("task")[0].as_py(), rows.column("tasks")[0].as_py()
        order = np.argsort(n, kind="stable")  # few large sets follow a small one
        sets = np.zeros((len(n), int(flat.max()) + 1), np.float32)
        sets[np.repeat(np.arange(len(n)), n), flat] = 1
        sets = sets[order]
        at, counts, held = [], [], 0
        mine = np.arange(task, len(sets), tasks)
        for p in range(0, len(mine), _AT_A_TIME):
            first = mine[p : p + _AT_A_TIME]
            common = sets[first] @ sets[first[0] :].T
            for x, shared in zip(first, common):
                later = np.flatnonzero(shared[x - first[0] + 1 :] >= support) + x + 1
                at.append(np.stack([np.full(len(later), order[x]), order[later]], axis=1))
                counts.append(shared[later - first[0]].astype(np.int64))
                held += len(later)
                for some, c in _larger(sets[np.ix_(later, np.flatnonzero(sets[x]))], support):
                    at.append(order[[[x, *later[some]]]])
                    counts.append(np.array([c]))
                    held += 1
                if held > 1 << 16:
                    yield from told(at, ids, counts)
                    at, counts, held = [], [], 0
        if held:
            yield from told(at, ids, counts)

    return run


def frequent_by_kind(baskets: DataFrame, support: int, whole: bool | None = None) -> DataFrame:
    """(items, support) as ``frequent`` has it, for many items in few baskets; null items are left out.

    Where hardly any items stand in the same baskets and all of them fit into a task (``whole``, by their number if None), each task
    intersects the baskets of a share of the items with all others and goes on from these, so nothing but what is found is ever listed.

    Items that stand in the same baskets are of one kind. Sets of kinds are found by intersecting the baskets of sets that differ in
    their last kind, so no occurrence is ever listed; a set of kinds is then told for every choice of some items of each.
    """
    rows = settled(baskets.select("b", "i").where("i is not null").distinct())
    single = supports(rows).where(F.col("support") >= support).select(F.array("i").alias("items"), "support")
    members = numbered_members(rows.select(F.col("i").alias("item"), F.col("b").alias("element")), F.lit(support))
    if whole is None:
        n, wide = members.agg(F.count("*"), F.max(F.element_at("members", -1))).first()
        most = members.groupBy("members").count().agg(F.max("count")).first()[0] or 0
        whole = n * ((wide or 0) + 1) <= _CELLS and n > 1000 and most <= 2
    if whole:
        tasks = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = members.select("item", F.col("members").cast("array<int>").alias("members"), "n", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(tasks).alias("tasks"))
        item = dict(members.dtypes)["item"]
        return single.unionByName(dealt.repartitionById(tasks, "task").mapInArrow(_tasks_sets(support), f"items array<{item}>, support long"))
    of, kind, links = kinds_of_members(members)
    choices = _choices(of)
    own = members.join(of, "item").groupBy("kind").agg(F.any_value("members").alias("baskets"))
    alike = kind.where("size > 1").join(choices, "kind").select(F.explode("sets").alias("items"), F.col("n").cast("long").alias("support")).where("size(items) > 1")
    left, right = (own.select(F.col("kind").alias(c), F.col("baskets").alias(f"_{c}")) for c in "xy")
    both = links.select("x", "y").join(left, "x").join(right, "y")
    level = settled(both.select(F.array("x").alias("first"), F.col("y").alias("last"), F.array_intersect("_x", "_y").alias("baskets")))
    out, k = single.unionByName(alike), 2
    while not level.isEmpty():
        out = out.unionByName(_chosen(level, choices, k))
        other = level.select("first", F.col("last").alias("next"), F.col("baskets").alias("_b"))
        longer = level.join(other, "first").where("last < next").select("first", "last", "next", F.array_intersect("baskets", "_b").alias("baskets"))
        level, k = settled(longer.where(F.size("baskets") >= support).select(F.concat("first", F.array("last")).alias("first"), F.col("next").alias("last"), "baskets")), k + 1
    return out


def _choices(of: DataFrame, most: int = 8) -> DataFrame:
    """(kind, sets): all choices of some items of a kind (item, kind), in parts of 2 ** ``most`` at most."""
    items = of.groupBy("kind").agg(F.sort_array(F.collect_list("item")).alias("items"))
    items = items.withColumn("n", F.when(F.size("items") < 63, F.size("items")).otherwise(F.raise_error(F.lit("a kind of 63 or more items has over 2 ** 62 sets"))))
    each = items.select("kind", "items", F.explode(F.expr("sequence(1L, shiftleft(1L, n - 1) - 1 + shiftleft(1L, n - 1))")).alias("m"))
    sets = each.select("kind", F.expr(f"shiftright(m, {most})").alias("part"), F.expr("filter(items, (x, j) -> getbit(m, j) = 1)").alias("s"))
    return settled(sets.groupBy("kind", "part").agg(F.collect_list("s").alias("sets")).select("kind", "sets"))


def _chosen(level: DataFrame, choices: DataFrame, k: int) -> DataFrame:
    """(items, support): ``level`` (first, last, baskets) of sets of ``k`` kinds, told for all choices of items."""
    rows = level.select(F.size("baskets").cast("long").alias("support"), *[F.col("first")[j].alias(f"k{j}") for j in range(k - 1)], F.col("last").alias(f"k{k - 1}"))
    for j in range(k):
        rows = rows.join(choices.select(F.col("kind").alias(f"k{j}"), F.col("sets").alias(f"s{j}")), f"k{j}").drop(f"k{j}")
    rows = rows.repartition(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for j in range(k):
        rows = rows.withColumn(f"s{j}", F.explode(f"s{j}"))
    return rows.select(F.sort_array(F.concat(*[f"s{j}" for j in range(k)])).alias("items"), "support")


def son_candidates(baskets: DataFrame, support: int, chunks: int, key: Column | None = None, most: int | None = None) -> DataFrame:
    """(items): the sets that are frequent in some chunk against the chunk's share of the support. Every set that is
    frequent over all is among them. Baskets go to chunks by ``key`` modulo ``chunks``; an empty chunk yields none."""
    dealt = baskets.withColumn("chunk", F.pmod(key if key is not None else F.xxhash64("b"), F.lit(chunks)).cast("int"))
    n = baskets.agg(F.countDistinct("b").alias("n"))
    need = dealt.groupBy("chunk").agg(F.countDistinct("b").alias("own")).crossJoin(F.broadcast(n))  # one row
    need = settled(need.select("chunk", F.ceil(F.col("own") * support / F.col("n")).alias("need")))
    return frequent(dealt, support, most, "chunk", need).select("items").distinct()


def son(baskets: DataFrame, support: int, chunks: int, key: Column | None = None, most: int | None = None) -> DataFrame:
    """(items, support): the second pass counts the candidates in all baskets. What is frequent in a chunk has only parts
    that are, so a basket's candidates of k + 1 items are found from its candidates of k items, level by level."""
    candidates = settled(son_candidates(baskets, support, chunks, key, most))
    single = candidates.where(F.size("items") == 1).select(F.col("items")[0].alias("i"))
    rows = settled(baskets.select("b", "i").distinct().join(single, "i", "left_semi"))
    found = rows.select("b", F.array("i").alias("items"), F.col("i").alias("last"))
    counted = []
    for k in range(1, (candidates.agg(F.max(F.size("items"))).first()[0] or 0) + 1):
        if k > 1:
            longer = found.join(rows, "b").where("i > last").select("b", F.concat("items", F.array("i")).alias("items"), F.col("i").alias("last"))
            found = settled(longer.join(candidates.where(F.size("items") == k), "items", "left_semi"))
        counted.append(found.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support))
    result = candidates.select("items", F.lit(0).cast("long").alias("support")).limit(0)
    for x in counted:
        result = result.unionByName(x)
    return result


def frequent_pairs(baskets: DataFrame, support: int) -> DataFrame:
    """(a, b, support) of pairs of frequent items in at least ``support`` baskets."""
    rows = baskets.select(F.col("b").alias("basket"), "i").distinct()
    single = supports(rows).where(F.col("support") >= support).select("i")
    rows = rows.join(single, "i", "left_semi")
    pairs = rows.withColumnRenamed("i", "a").join(rows.withColumnRenamed("i", "b"), "basket").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def pcy_pairs(baskets: DataFrame, support: int, buckets: int = 1009, a: int = 31, c: int = 17) -> DataFrame:
    """(a, b, bucket, bucket_count, support): frequent pairs of integer items, counted only in buckets of pairs that are
    frequent as a whole (bucket (a x + c y) mod ``buckets``)."""
    rows = baskets.select(F.col("b").alias("basket"), F.col("i").cast("long").alias("i")).distinct()
    single = supports(rows).where(F.col("support") >= support).select("i")
    pairs = rows.withColumnRenamed("i", "a").join(rows.withColumnRenamed("i", "b"), "basket").where("a < b")
    pairs = pairs.withColumn("bucket", (F.col("a") * a + F.col("b") * c) % buckets)
    full = pairs.groupBy("bucket").agg(F.count("*").alias("bucket_count")).where(F.col("bucket_count") >= support)
    kept = pairs.join(F.broadcast(full), "bucket")  # `buckets` rows at most
    kept = kept.join(single.withColumnRenamed("i", "a"), "a", "left_semi").join(single.withColumnRenamed("i", "b"), "b", "left_semi")
    return kept.groupBy("a", "b", "bucket", "bucket_count").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def fp_growth(baskets: DataFrame, support: int) -> DataFrame:
    """(items, support) by the built-in FP-growth, as a cross-check."""
    from pyspark.ml.fpm import FPGrowth

    sets = as_sets(baskets)
    n = sets.count()
    if not n:
        return sets.select("items", F.lit(0).cast("long").alias("support")).limit(0)
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (support - 0.5) / n)).fit(sets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))
