"""MinHash signatures by linear hashes, banding and exact Jaccard over sets given as (item, element)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..functions.ranking import indexed

#: Rows of a band and bands.
ROWS, BANDS = 2, 50


def hash_parameters(n: int = ROWS * BANDS) -> list[tuple[int, int, int]]:
    """(j, a, b) of n linear hashes, by rule."""
    return [(j, 7919 * (j + 1) % 104729, 1299709 * (j + 3) % 15485863) for j in range(n)]


def element_index(sets: DataFrame) -> DataFrame:
    """(element, idx): distinct elements numbered from 0 in their order, range by range."""
    return indexed(sets.select("element").distinct(), "element")


def characteristic_matrix(sets: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(item, members): each item's sorted element indices."""
    index = element_index(sets) if index is None else index
    rows = sets.distinct().join(index, "element")
    return rows.groupBy("item").agg(F.array_sort(F.collect_set("idx")).alias("members"))


def signatures(sets: DataFrame, modulus: int | None = None, n: int = ROWS * BANDS) -> DataFrame:
    """(item, sig): the minimum of (a idx + b) mod m over the item's elements for each of n hashes; m is the number of
    distinct elements unless given."""
    index = element_index(sets)
    return signed(characteristic_matrix(sets, index), index, modulus, n).drop("members")


def signed(matrix: DataFrame, index: DataFrame, modulus: int | None = None, n: int = ROWS * BANDS) -> DataFrame:
    """(item, members, sig): as ``signatures``, from the matrix."""
    count = index.agg(F.count("*").alias("m")) if modulus is None else index.sparkSession.range(1).select(F.lit(modulus).cast("long").alias("m"))
    rows = matrix.crossJoin(F.broadcast(count))  # one row
    each = [F.expr(f"array_min(transform(members, x -> (x * {a}L + {b}L) % m))") for _, a, b in hash_parameters(n)]
    return rows.select("item", "members", F.array(*each).alias("sig"))


def bands(signed: DataFrame, rows: int = ROWS) -> DataFrame:
    """(item, band, key): the key holds the band's values themselves, so different values never meet."""
    n = F.expr(f"size(sig) div {rows}")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(b.alias("band"), F.array_join(F.slice("sig", b * rows + 1, rows).cast("array<string>"), ",").alias("key")))
    return signed.select("item", F.explode(each).alias("x")).select("item", "x.band", "x.key")


def candidates(signed: DataFrame, rows: int = ROWS) -> DataFrame:
    """(a, b): pairs of items that share a band."""
    own = bands(signed, rows)
    other = own.withColumnRenamed("item", "b")
    return own.withColumnRenamed("item", "a").join(other, ["band", "key"]).where("a < b").select("a", "b").distinct()


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity): the exact Jaccard of each pair, from arrays of elements."""
    return _jaccard(pairs, sets.groupBy("item").agg(F.collect_set("element").alias("members")))


def _jaccard(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    sides = (matrix.select(F.col("item").alias(x), F.col("members").alias(f"s{x}")) for x in ("a", "b"))
    both = pairs.join(next(sides), "a").join(next(sides), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))


def alike(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with equal members are of one kind: (item, kind) and (kind, members, size). Null items are left out."""
    matrix = settled(matrix.where("item is not null"))
    kind = settled(indexed(matrix.groupBy("members").agg(F.count("*").alias("size")), "members", "kind"))
    return settled(matrix.join(kind.select("members", "kind"), "members").select("item", "kind")), kind


def _told(of: DataFrame, kind: DataFrame, pairs: DataFrame, **same: float) -> DataFrame:
    """(a, b) with a < b and what else ``pairs`` (a, b) of kinds carry, for all their items; items of one kind are a pair with ``same``."""
    pairs = pairs.withColumnRenamed("a", "x").withColumnRenamed("b", "y")
    own = kind.where("size > 1").select(F.col("kind").alias("x"), F.col("kind").alias("y"), *[F.lit(v).alias(c) for c, v in same.items()])
    rows = expanded(of, settled(pairs.unionByName(own))).where("x <> y or a < b")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *same)


def candidate_pairs(sets: DataFrame, modulus: int | None = None, tiled: bool | None = None) -> DataFrame:
    """(a, b): pairs of items that share a band. Found between kinds of equal sets, then told for all their items; or, where bands meet
    nearly all others, by comparing every two items (``tiled``, by what takes less if None)."""
    index = element_index(sets)
    of, kind = alike(characteristic_matrix(sets, index))
    rows = settled(signed(kind.withColumnRenamed("kind", "item"), index, modulus).drop("members"))
    if _better_compared(rows.select("item", F.col("sig").alias("keys")), ROWS, of, 2e-8) if tiled is None else tiled:
        return _tiled_candidates(settled(of.join(rows.select(F.col("item").alias("kind"), F.col("sig").alias("keys")), "kind").drop("kind")), ROWS)
    return _told(of, kind, candidates(rows))


def similar_pairs(sets: DataFrame, threshold: float = 0.5, modulus: int | None = None, tiled: bool | None = None) -> DataFrame:
    """(a, b, similarity) at or above ``threshold``, of pairs that share a band. Found between kinds of equal sets, then told for
    all their items; or, where bands meet nearly all others, by comparing every two items (``tiled``, by what takes less if None)."""
    index = element_index(sets)
    of, kind = alike(characteristic_matrix(sets, index))
    rows = settled(signed(kind.withColumnRenamed("kind", "item"), index, modulus))
    if _better_compared(rows.select("item", F.col("sig").alias("keys")), ROWS, of, _tile_cost(rows)) if tiled is None else tiled:
        keyed = of.join(rows.select(F.col("item").alias("kind"), "members", _needed(threshold), F.col("sig").alias("keys")), "kind")
        return _ordered(_tiled(settled(keyed.drop("kind").withColumnRenamed("item", "id")), threshold, ROWS)).where(F.col("similarity") >= threshold)
    return _told(of, kind, _jaccard(candidates(rows), rows).where(F.col("similarity") >= threshold), similarity=1.0).where(F.col("similarity") >= threshold)


def _needed(threshold: float) -> Column:
    """How many elements a set of ``members`` has to share for a Jaccard of ``threshold``."""
    return F.greatest(F.ceil(F.size("members") * threshold - 1e-9), F.lit(1)).cast("int").alias("need")


def _ordered(tiles: DataFrame) -> DataFrame:
    """(a, b, similarity) with a < b of what ``_tiled`` has found."""
    return tiles.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))


def overlaps(sets: DataFrame) -> DataFrame:
    """(a, b, common): shared elements of each pair that has any, by a join on the element."""
    rows = sets.select("item", "element").distinct()
    other = rows.select(F.col("item").alias("b"), "element")
    return rows.withColumnRenamed("item", "a").join(other, "element").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


#: Sets of a tile that are compared at a time, and elements that they are laid out over.
_ROWS, _WIDE = 1024, 4096


def _laid_out(flat: np.ndarray, start: np.ndarray, rows: slice, first: int) -> np.ndarray:
    """A row of zeros and ones for each of these sets, over the elements from ``first`` on."""
    own, n = flat[start[rows.start] : start[rows.stop]], np.diff(start[rows.start : rows.stop + 1])
    at = np.repeat(np.arange(len(n)), n)
    here = (own >= first) & (own < first + _WIDE)
    out = np.zeros((len(n), min(_WIDE, max(0, int(flat.max(initial=-1)) + 1 - first))), np.float32)
    out[at[here], own[here] - first] = 1
    return out


def _band_numbers(keys: list[np.ndarray], width: int) -> list[np.ndarray]:
    """A number for each band of ``width`` keys of each row, the same for equal bands of all these tables."""
    every = np.concatenate(keys)
    out = np.empty((len(every), every.shape[1] // width), np.uint16 if len(every) <= 1 << 16 else np.int64)
    number = lambda x: np.unique(x, return_inverse=True)[1]
    for b in range(out.shape[1]):
        key = number(every[:, b * width])
        for c in range(b * width + 1, (b + 1) * width):
            key = number(key * len(every) + number(every[:, c]))
        out[:, b] = key
    return np.split(out, np.cumsum([len(x) for x in keys])[:-1])


def _share_band(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 8) -> np.ndarray:
    """Whether rows i of x and j of y have some band in common."""
    found, rest = np.zeros(len(i), bool), np.arange(len(i))
    for p in range(0, x.shape[1], step):
        hit = (x[i[rest], p : p + step] == y[j[rest], p : p + step]).any(axis=1)
        found[rest[hit]] = True
        rest = rest[~hit]
    return found


def _keys(own: pa.Table) -> np.ndarray:
    return pc.list_flatten(own.column("keys")).to_numpy().reshape(len(own), -1)


def _tile_met(share: float, width: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares each set of block ``lo`` with each of block ``hi`` by a product of zeros and ones, which counts what they share. With
    ``width`` only pairs are found that also share a band of so many keys."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        if len(pc.unique(rows.column("block"))) < len({lo, hi}):
            return  # one of them is empty
        sides = []
        for block in {lo, hi}:
            own = rows.filter(pc.equal(rows.column("block"), block)).combine_chunks()
            start = np.append(0, np.cumsum(pc.list_value_length(own.column("members")).to_numpy()))
            flat = pc.list_flatten(own.column("members")).to_numpy()
            sides.append((block, own.column("id").combine_chunks(), flat, start, own.column("need").to_numpy(), _keys(own) if width else None))
        del batches, rows
        (_, id_x, flat_x, start_x, need_x, key_x), (_, id_y, flat_y, start_y, need_y, key_y) = min(sides), max(sides)
        if width:
            key_x, key_y = _band_numbers([key_x, key_y], width)
        wide = max(flat_x.max(initial=-1), flat_y.max(initial=-1)) + 1
        for p in range(0, len(id_x), _ROWS):
            x = slice(p, min(p + _ROWS, len(id_x)))
            for q in range(p if lo == hi else 0, len(id_y), _ROWS):
                y = slice(q, min(q + _ROWS, len(id_y)))
                common = np.zeros((x.stop - x.start, y.stop - y.start), np.float32)
                for first in range(0, wide, _WIDE):
                    of_x, of_y = _laid_out(flat_x, start_x, x, first), _laid_out(flat_y, start_y, y, first)
                    both = min(of_x.shape[1], of_y.shape[1])
                    common += of_x[:, :both] @ of_y[:, :both].T
                i, j = np.divmod(np.flatnonzero(common >= need_x[x, None]), common.shape[1])
                found, i, j = common[i, j].astype(np.int64), i + x.start, j + y.start
                nx, ny = (start_x[i + 1] - start_x[i]), (start_y[j + 1] - start_y[j])
                kept = (found >= need_y[j]) & ((i < j) | (lo != hi)) & (found >= share * (nx + ny - found))
                if width:
                    kept[kept] = _share_band(key_x, key_y, i[kept], j[kept])
                i, j = pa.array(i[kept]), pa.array(j[kept])
                yield pa.RecordBatch.from_arrays([id_x.take(i), id_y.take(j), pa.array(found[kept]), pa.array(nx[kept].astype(np.int32)), pa.array(ny[kept].astype(np.int32))], ["a", "b", "common", "na", "nb"])

    return met


def _tiled(sets: DataFrame, share: float = 0.0, width: int = 0, least: int = 8, most: int = 1 << 15) -> DataFrame:
    """(a, b, common, na, nb): each pair of ``sets`` (id, members, need) once that shares as many elements as either needs, and, but for
    rounding, ``share`` of their union; with ``width`` also a band of so many of their ``keys``. Sets are dealt into blocks, every two
    blocks meet in a task, and only what is found leaves it."""
    blocks = max(least, -(-sets.count() // most))
    rows = sets.select("id", F.col("need").cast("int").alias("need"), F.col("members").cast("array<int>").alias("members"), F.expr(f"pmod(xxhash64(id, 17), {blocks})").cast("int").alias("block"), *["keys"] * bool(width))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "need", "members", *["keys"] * bool(width), "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = rows.repartitionById(blocks * (blocks + 1) // 2, F.expr("cast(hi * (hi + 1) / 2 + lo as int)"))
    kind = dict(sets.dtypes)["id"]
    return dealt.mapInArrow(_tile_met(share - 1e-9, width), f"a {kind}, b {kind}, common long, na int, nb int")


def _tile_banded(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each item of block ``lo`` the later ones of block ``hi`` that share a band of ``width`` keys."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by("rank").combine_chunks()
        del batches
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        if len(pc.unique(rows.column("block"))) < len({lo, hi}):
            return  # one of them is empty
        first, last = (rows.filter(pc.equal(rows.column("block"), x)).combine_chunks() for x in (lo, hi))
        del rows
        id_x, id_y = (x.column("id").combine_chunks() for x in (first, last))
        key_x, key_y = (np.ascontiguousarray(x.T) for x in _band_numbers([_keys(first), _keys(last)], width))
        for p in range(0, len(id_x), _ROWS):
            for q in range(p if lo == hi else 0, len(id_y), _ROWS):
                x, y = key_x[:, p : p + _ROWS], key_y[:, q : q + _ROWS]
                met = np.zeros((x.shape[1], y.shape[1]), bool)
                for a, b in zip(x, y):
                    met |= a[:, None] == b
                if lo == hi and p == q:
                    met = np.triu(met, 1)
                ends = np.append(0, np.cumsum(met.sum(axis=1))).astype(np.int32)
                b = id_y.take(pa.array(np.flatnonzero(met) % met.shape[1] + q))
                yield pa.RecordBatch.from_arrays([id_x.slice(p, x.shape[1]), pa.ListArray.from_arrays(pa.array(ends), b)], ["a", "b"])

    return met


def _tiled_candidates(rows: DataFrame, width: int, least: int = 12, most: int = 1 << 15) -> DataFrame:
    """(a, b) with a < b: items of ``rows`` (item, keys) that share a band of ``width`` keys. Ranges of items are blocks, every two blocks
    meet in a task, and only what is found leaves it."""
    n = rows.count()
    blocks = max(least, -(-n // most))
    ranked = indexed(rows, "item", "rank").select(F.col("item").alias("id"), "keys", "rank", F.expr(f"cast(rank * {blocks} div {max(n, 1)} as int)").alias("block"))
    ranked = ranked.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ranked = ranked.select("id", "keys", "rank", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = ranked.repartitionById(blocks * (blocks + 1) // 2, F.expr("cast(hi * (hi + 1) / 2 + lo as int)"))
    kind = dict(rows.dtypes)["item"]
    return dealt.mapInArrow(_tile_banded(width), f"a {kind}, b array<{kind}>").select("a", F.explode("b").alias("b"))


def _tile_cost(sets: DataFrame) -> float:
    """Seconds that comparing a pair of ``sets`` (members) takes: some nanoseconds, and more for each element."""
    return 2e-9 + 4e-11 * ((sets.agg(F.max(F.array_max("members"))).first()[0] or 0) + 1)


def _better_compared(rows: DataFrame, width: int, items: DataFrame, each: float) -> bool:
    """Whether it takes less to compare each pair of ``items``, at ``each`` seconds and one to begin with, than to join those of ``rows``
    (item, keys) that share a band of ``width`` keys. Some microsecond for a row of that join."""
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"size(keys) div {width} - 1")), lambda b: F.slice("keys", b * width + 1, width)))
    met = rows.select(band.alias("band", "key")).groupBy("band", "key").agg(F.count("*").cast("double").alias("g"))
    joined = met.agg(F.sum(F.col("g") * (F.col("g") - 1) / 2)).first()[0] or 0.0
    n = items.count()
    return joined * 1e-6 > 1 + n * n / 2 * each


def _better_tiled(sets: DataFrame) -> bool:
    """Whether it takes less to compare each pair of ``sets`` (members, n, need) than those that meet by a rare element, as a join of
    these would make so many rows. Some microsecond for such a row, some nanoseconds for a pair and more for each element."""
    first = sets.select(F.explode(F.slice("members", F.lit(1), F.expr("n - need + 1"))).alias("idx")).groupBy("idx").agg(F.count("*").cast("double").alias("g"))
    rows = first.agg(F.sum(F.col("g") * (F.col("g") - 1) / 2)).first()[0] or 0.0
    n, wide = sets.agg(F.count("*"), F.max(F.element_at("members", -1))).first()
    return rows * 1e-6 > n * n / 2 * (2e-9 + 4e-11 * ((wide or 0) + 1))


def numbered_members(sets: DataFrame, need: Column) -> DataFrame:
    """(item, members, n, need): the numbers of each item's elements from the rarest to the commonest. Sets smaller than their need, null
    items and null elements are left out."""
    rows = settled(sets.select("item", "element").where("item is not null and element is not null").distinct())
    by_rarity = indexed(rows.groupBy("element").agg(F.count("*").alias("n")).select(F.struct("n", "element").alias("k")), "k")
    members = rows.join(by_rarity.select("k.element", "idx"), "element").groupBy("item").agg(F.array_sort(F.collect_list("idx")).alias("members"))
    return settled(members.withColumn("n", F.size("members")).withColumn("need", F.greatest(need, F.lit(1)).cast("int")).where("n >= need"))


def kinds(sets: DataFrame, need: Column, tiled: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with equal sets are of one kind: (item, kind), (kind, n, size) and (x, y, common, nx, ny) with x < y, the pairs of
    kinds that share as many elements as ``need`` asks of either set, given the set's size ``n``. Sets smaller than their
    need are left out, so items of one kind always share enough.

    Elements are numbered from the rarest to the commonest. The rarest element that such a pair shares is followed by
    the others in both sets, so it stands among the first n - need + 1 of each: only those are joined, and the common
    elements of a set meet nobody. What is found there is counted on the whole sets. Where these still meet nearly all others,
    every two kinds are compared instead (``tiled``, by what takes less if None). Null items and elements are left out.
    """
    return kinds_of_members(numbered_members(sets, need), tiled)


def kinds_of_members(members: DataFrame, tiled: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``kinds`` of sets that ``numbered_members`` has numbered."""
    kind = settled(indexed(members.groupBy("members", "n", "need").agg(F.count("*").alias("size")), "members", "kind"))
    of = settled(members.select("item", "members").join(kind.select("members", "kind"), "members").select("item", "kind"))
    if _better_tiled(kind) if tiled is None else tiled:
        found = _tiled(kind.select(F.col("kind").alias("id"), "members", "need"))
        swap = lambda p, q: F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q))
        links = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "common", swap("na", "nb").alias("nx"), swap("nb", "na").alias("ny"))
        return of, kind.select("kind", "n", "size"), settled(links)
    first = kind.select("kind", F.explode(F.slice("members", F.lit(1), F.expr("n - need + 1"))).alias("idx"))
    pairs = first.withColumnRenamed("kind", "x").join(first.withColumnRenamed("kind", "y"), "idx").where("x < y").select("x", "y").distinct()
    left, right = (kind.select(F.col("kind").alias(i), F.col("members").alias(f"m{i}"), F.col("n").alias(f"n{i}"), F.col("need").alias(f"need{i}")) for i in "xy")
    found = pairs.join(left, "x").join(right, "y").withColumn("common", F.size(F.array_intersect("mx", "my")).cast("long"))
    links = settled(found.where("common >= greatest(needx, needy)").select("x", "y", "common", "nx", "ny"))
    return of, kind.select("kind", "n", "size"), links


def expanded(of: DataFrame, pairs: DataFrame, most: int = 256) -> DataFrame:
    """(a, b) and what else ``pairs`` (x, y) of kinds carry, for all items a of x and b of y but an item with itself. Kinds are
    cut into parts of some ``most`` items, so that a large one is spread over tasks; nothing is shuffled once it is expanded."""
    parts = of.join(of.groupBy("kind").agg(F.ceil(F.count("*") / most).alias("_p")), "kind").groupBy("kind", F.expr("pmod(xxhash64(item), _p)").alias("_p"))
    parts = settled(parts.agg(F.collect_list("item").alias("items")).select("kind", "items"))
    left, right = (parts.select(F.col("kind").alias(i), F.col("items").alias(f"_{i}")) for i in "xy")
    met = pairs.join(left, "x").join(right, "y").repartition(int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in pairs.columns if c not in ("x", "y")]
    met = met.select(*rest, "x", "y", "_y", F.explode("_x").alias("a"))
    return met.select("a", F.explode("_y").alias("b"), "x", "y", *rest).where("x <> y or a <> b")


def filtered_overlaps(sets: DataFrame, need: Column, share: float = 0.0, tiled: bool | None = None) -> DataFrame:
    """(a, b, common, na, nb): pairs of items that share as many elements as ``need`` asks of either set, given the set's size
    ``n``; of those below ``share`` of their union some may be left out. Found between kinds of equal sets, then told for all their
    items; or, where rare elements still meet nearly all others, by comparing every two items (``tiled``, by what takes less if None)."""
    members, swap = numbered_members(sets, need), lambda p, q: F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q))
    if _better_tiled(members) if tiled is None else tiled:
        rows = _tiled(members.withColumnRenamed("item", "id"), share)
        return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", swap("na", "nb").alias("na"), swap("nb", "na").alias("nb"))
    of, kind, links = kinds_of_members(members, tiled)
    alike = kind.where("size > 1").select(F.col("kind").alias("x"), F.col("kind").alias("y"), F.col("n").cast("long").alias("common"), F.col("n").alias("nx"), F.col("n").alias("ny"))
    rows = expanded(of, links.unionByName(alike)).where("x <> y or a < b")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", swap("nx", "ny").alias("na"), swap("ny", "nx").alias("nb"))


def exact_pairs(sets: DataFrame, threshold: float = 0.5, tiled: bool | None = None) -> DataFrame:
    """(a, b, similarity) at or above ``threshold``, of all pairs that share an element."""
    rows = filtered_overlaps(sets, F.ceil(F.col("n") * threshold - 1e-9), threshold, tiled)
    rows = rows.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))
    return rows.where(F.col("similarity") >= threshold)


def mllib_pairs(sets: DataFrame, threshold: float = 0.5, tables: int = 20, seed: int = 7, tiled: bool | None = None) -> DataFrame:
    """(a, b, similarity) by the built-in MinHashLSH, as an alternative: between kinds of equal sets, which hash alike, then told for all
    their items; or, where its hashes meet nearly all others, by comparing every two items (``tiled``, by what takes less if None)."""
    from pyspark.ml.feature import CountVectorizer, MinHashLSH
    from pyspark.ml.functions import vector_to_array

    arrays = sets.groupBy("item").agg(F.array_sort(F.collect_set("element")).alias("members"))
    of, kind = alike(arrays)
    counts = CountVectorizer(inputCol="members", outputCol="v", binary=True).fit(arrays)
    vectors = settled(counts.transform(kind).select("kind", "v"))
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=tables, seed=seed).fit(vectors)
    hashes = F.array(*[vector_to_array(F.col("h")[j])[0].cast("long") for j in range(tables)])
    keyed = settled(model.transform(vectors).select(F.col("kind").alias("item"), hashes.alias("keys")))
    matrix = settled(characteristic_matrix(sets).where("item is not null"))
    if _better_compared(keyed, 1, of, _tile_cost(matrix)) if tiled is None else tiled:
        rows = matrix.join(of.join(keyed.withColumnRenamed("item", "kind"), "kind"), "item").select(F.col("item").alias("id"), "members", _needed(threshold), "keys")
        return _ordered(_tiled(settled(rows), threshold, 1)).where(F.col("similarity") > threshold - 1e-12)
    rows = model.approxSimilarityJoin(vectors, vectors, 1 - threshold + 1e-12, "distance")
    rows = rows.where("datasetA.kind < datasetB.kind").select(F.col("datasetA.kind").alias("a"), F.col("datasetB.kind").alias("b"), (1 - F.col("distance")).alias("similarity"))
    return _told(of, kind, rows, similarity=1.0)
