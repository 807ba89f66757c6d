"""Item-based collaborative filtering, fallbacks, feature tables and blending, on (u, i, rating)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import release, settled
from ..functions.scalar import bucketed


def averages(ratings: DataFrame, key: str, name: str = "average") -> DataFrame:
    """(key, average, n)."""
    return ratings.groupBy(key).agg(F.avg("rating").alias(name), F.count("*").alias("n"))


def global_average(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average"))


def centred(ratings: DataFrame) -> DataFrame:
    """(u, i, z): ratings less the mean of all the item's ratings."""
    means = ratings.groupBy("i").agg(F.avg("rating").alias("mean"))
    return ratings.join(means, "i").select("u", "i", (F.col("rating") - F.col("mean")).alias("z"))


def item_blocks(ratings: DataFrame, blocks: int | None = None) -> tuple[list, int]:
    """The first items of all ranges of items but the first, and the number of ranges, which have about as many ratings each.
    The driver gets eight values a range."""
    blocks = blocks or max(2, int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    n = ratings.where("i is not null").groupBy("i").agg(F.count("*").alias("n")).repartitionByRange(8 * blocks, "i")
    fine = n.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("i").alias("i"), F.sum("n").alias("n")).orderBy("p").collect()
    share, bounds, before = sum(r.n for r in fine) / blocks, [], 0
    for r in fine:
        if before >= share * (len(bounds) + 1):
            bounds.append(r.i)
        before += r.n
    return bounds, len(bounds) + 1


def _block(item: Column, bounds: list, first: int = 0) -> Column:
    """The number of ``bounds`` at or below the item, by halving."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(item < F.lit(bounds[half]), _block(item, bounds[:half], first)).otherwise(_block(item, bounds[half + 1 :], first + half + 1))


def pearson(ratings: DataFrame, both_ways: bool = False, blocks: tuple[list, int] | None = None) -> DataFrame:
    """(a, b, similarity): correlation over common raters, centred by each item's mean over all its raters; 0 if either
    has no spread there. Pairs without a common rater are absent.

    Items are dealt into ranges; a user's ratings go, once for each range that the user has an item of, to the task of that
    range. It pairs that range's items with all larger ones and sums up, so rows of pairs are never shuffled.
    """
    bounds, n = blocks or item_blocks(ratings)
    z = centred(ratings).where("u is not null and i is not null")
    users = z.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("x"))
    users = users.select(F.col("x.i").alias("i"), F.col("x.z").alias("z")).withColumn("at", F.transform("i", lambda i: _block(i, bounds)))
    dealt = users.select("i", "z", "at", F.explode(F.array_distinct("at")).alias("block"))
    dealt = dealt.withColumn("k", F.array_position("at", F.col("block")).cast("int")).withColumn("own", F.size(F.filter("at", lambda x: x == F.col("block"))))
    dealt = dealt.select("block", "own", *[F.slice(c, F.col("k"), F.size("at")).alias(c) for c in ("i", "z")]).where(F.size("i") > 1).repartitionById(n, "block")
    left = dealt.select("block", "i", "z", F.posexplode(F.slice("i", F.lit(1), F.least(F.col("own"), F.size("i") - 1))).alias("p", "a"))
    pairs = left.select("block", "a", F.get("z", F.col("p")).alias("za"), "i", "z", F.explode(F.sequence(F.col("p") + 1, F.size("i") - 1)).alias("q"))
    pairs = pairs.select("block", "a", F.get("i", F.col("q")).alias("b"), "za", F.get("z", F.col("q")).alias("zb")).where("a < b")
    sums = pairs.groupBy("block", "a", "b").agg(F.sum(F.col("za") * F.col("zb")).alias("ab"), F.sum(F.col("za") * F.col("za")).alias("aa"), F.sum(F.col("zb") * F.col("zb")).alias("bb"))
    below = F.sqrt(F.col("aa") * F.col("bb"))
    out = sums.select("a", "b", F.when(below == 0, F.lit(0.0)).otherwise(F.col("ab") / F.when(below == 0, F.lit(1.0)).otherwise(below)).alias("similarity"))
    return _both_ways(out) if both_ways else out


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.inline(F.array(F.struct("a", "b", "similarity"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))))


#: Ratings of one range of items that are held side by side while their pairs are summed up.
_PIECE = 1 << 18

#: Ratings that a task holds, about, and copies of all ratings that stand on disk at a time.
_HELD, _COPIES = 3_000_000, 5


def _in_line(items: DataFrame) -> DataFrame:
    """(i, mean, n) and how many ratings the items ``before`` have, sorted by range, so that only the ranges' sums meet."""
    rows = settled(items.repartitionByRange("i").sortWithinPartitions("i").withColumn("_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(F.col("_p").alias("_k")).agg(F.sum("n").alias("_n")).select("_k", F.coalesce(F.sum("_n").over(upto(Window.partitionBy(F.lit(0)).orderBy("_k"))), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_own", F.coalesce(F.sum("n").over(upto(Window.partitionBy("_p").orderBy("_m"))), F.lit(0)))
    rows = rows.join(F.broadcast(ranges), F.col("_p") == F.col("_k"))  # a row for each range
    return rows.withColumn("before", F.col("_before") + F.col("_own")).drop("_m", "_p", "_k", "_before", "_own")


def _spread(rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ratings of these users, one user after the other."""
    n = size[rows]
    return np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _pieces(n: np.ndarray) -> list[slice]:
    """Slices of what has these sizes, of some ``_PIECE`` each."""
    cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // _PIECE)) + 1
    return [slice(p, q) for p, q in zip([0, *cuts], [*cuts, len(n)], strict=True)] if len(n) else []


def _neighbours(item: np.ndarray, r: np.ndarray, z: np.ndarray, start: np.ndarray, size: np.ndarray, raters: tuple, asked: tuple, fallback: np.ndarray) -> np.ndarray:
    """What is predicted for each of ``asked`` (item, user), sorted by item, from ``raters`` (item, user, z), all ratings of the
    asked items in that order. ``item``, ``r`` and ``z`` are the ratings of user k from ``start`` on, ``size`` of them.

    Correlations of some items at a time with all others are summed up, used for these items' targets, and dropped.
    """
    width, out = len(fallback), fallback[asked[0]]
    wanted = np.unique(asked[0])
    first, last = np.searchsorted(raters[0], wanted), np.searchsorted(raters[0], wanted, side="right")
    of, to = np.searchsorted(asked[0], wanted), np.searchsorted(asked[0], wanted, side="right")
    work = np.append(0, np.cumsum(size[raters[1]]))
    for some in _pieces(work[last] - work[first]):
        these = wanted[some]
        own = _spread(np.arange(len(these)), first[some], (last - first)[some])
        at, user, mine = np.searchsorted(these, raters[0][own]), raters[1][own], raters[2][own]
        n = size[user]
        full = len(these) * width <= 4 * n.sum() + _PIECE  # a cell for each pair, else those that occur
        places, sums = None, [np.zeros(len(these) * width) for _ in range(3)] if full else None
        for part in _pieces(n) if full else [slice(None)]:
            x = _spread(user[part], start, size)
            key, za, zb = np.repeat(at[part] * width, n[part]) + item[x], np.repeat(mine[part], n[part]), z[x]
            if not full:
                places, key = np.unique(key, return_inverse=True)
            got = [np.bincount(key, w, len(these) * width if full else len(places)) for w in (za * zb, za * za, zb * zb)]
            sums = [p + q for p, q in zip(sums, got, strict=True)] if full else got
        below = np.sqrt(sums[1] * sums[2])
        near = np.maximum(np.divide(sums[0], below, out=np.zeros(len(below)), where=below != 0), 0)
        itself = np.arange(len(these)) * width + these
        if full:
            near[itself] = 0
        else:
            near[np.isin(places, itself)] = 0
        who = _spread(np.arange(len(these)), of[some], (to - of)[some])
        for part in _pieces(size[asked[1][who]]):
            goal = who[part]
            user, at = asked[1][goal], np.searchsorted(these, asked[0][goal])
            n, x = size[user], _spread(user, start, size)
            key = np.repeat(at * width, n) + item[x]
            if full:
                w = near[key]
            else:
                k = np.minimum(np.searchsorted(places, key), max(0, len(places) - 1))
                w = np.where(places[k] == key, near[k], 0.0) if len(places) else np.zeros(len(key))
            line = np.repeat(np.arange(len(goal)), n)
            up, down = np.bincount(line, w * r[x], len(goal)), np.bincount(line, w, len(goal))
            out[goal] = np.where(up * down != 0, np.divide(up, down, out=np.zeros(len(goal)), where=down != 0), out[goal])
    return out


def _ranges_predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The predictions of a range of items, from the users that rated or are asked for one of them, with all their ratings. The items'
    means come with the ratings, or else in rows without a user."""
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    del batches
    told = rows.filter(pc.is_null(rows.column("u"))).select(["i", "r"])
    rows = rows.filter(pc.is_valid(rows.column("u"))).combine_chunks()
    if not len(rows):
        return
    flat = lambda c: pc.list_flatten(rows.column(c)).combine_chunks()
    sizes = lambda c: pc.list_value_length(rows.column(c)).to_numpy().astype(np.int64)
    size, more = sizes("i"), sizes("ti")
    names = pa.concat_arrays([flat("i"), flat("ti")]).dictionary_encode()
    code, names = names.indices.to_numpy(), names.dictionary
    item, extra = code[: size.sum()], code[size.sum() :]
    r, mean, target = (flat(c).to_numpy(zero_copy_only=False) for c in ("r", "m", "g"))
    means = np.zeros(len(names))
    if len(told):
        at = pc.index_in(pc.list_flatten(told.column("i")), value_set=names).combine_chunks()
        means[at.drop_null().to_numpy()] = pc.list_flatten(told.column("r")).combine_chunks().filter(at.is_valid()).to_numpy()
    else:
        means[item] = mean
    means[extra] = flat("tm").to_numpy(zero_copy_only=False)
    k, own, asks = (rows.column(c).to_numpy() for c in ("k", "own", "asks"))
    user, mean_of = rows.column("u").combine_chunks(), rows.column("user_mean").combine_chunks()
    del rows, mean
    z, start = r - means[item], np.cumsum(size) - size
    place = _spread(np.arange(len(size)), start + k, own)
    order = place[np.argsort(item[place], kind="stable")]
    who = np.repeat(np.arange(len(size)), size)
    raters = item[order], who[order], z[order]
    goal = order[target[order] & asks[who[order]]]
    of_item, of_user = np.append(item[goal], extra), np.append(who[goal], np.repeat(np.arange(len(more)), more))
    rated = np.append(goal, np.full(len(extra), -1))
    order = np.argsort(of_item, kind="stable")
    of_item, of_user, rated = of_item[order], of_user[order], rated[order]
    found = _neighbours(item, r, z, start, size, raters, (of_item, of_user), means)
    for p in range(0, len(found), 1 << 16):
        x = slice(p, p + (1 << 16))
        given = pa.array(r[rated[x]] if len(r) else np.zeros(len(rated[x])), mask=rated[x] < 0)
        columns = [user.take(pa.array(of_user[x])), names.take(pa.array(of_item[x])), given, pa.array(means[of_item[x]]), mean_of.take(pa.array(of_user[x])), pa.array(found[x])]
        yield pa.RecordBatch.from_arrays(columns, ["u", "i", "rating", "item_mean", "user_mean", "prediction"])


def cf_predict(ratings: DataFrame, targets: DataFrame, min_neighbors: int = 60, more: bool = False) -> DataFrame:
    """(u, i, prediction) for each distinct target (u, i); with ``more`` also the target's own rating and the means of its item and
    user, null where there are none.

    Item and user unknown: 0. User unknown: the item's mean. Item unknown: the user's mean. A user with up to
    ``min_neighbors`` other items, or without any of positive similarity, gets the item's mean; else the mean of the
    user's other ratings weighted by positive similarity (that of ``pearson``).

    Items are dealt into ranges. A user's ratings go, once for each range that the user has an item of, to the task of that range:
    it sums up its items' similarities and uses them there, so neither pairs nor similarities are ever shuffled or stored. Ranges are
    as many as it takes for a task to hold some ``_HELD`` ratings; where that takes many copies of the ratings, the ranges come one part
    after the other, so that only some ``_COPIES`` stand on disk at a time.
    ``ratings`` are read more than once, so they are best settled before.
    """
    same, spark = targets is ratings, ratings.sparkSession
    items = settled(_in_line(averages(ratings.where("i is not null"), "i", "mean")))
    total = items.agg(F.sum("n")).first()[0] or 1
    rows = ratings.select("u", "i", F.col("rating").cast("double").alias("rating"), F.lit(same).alias("target"))
    if not same:
        asked = targets.select("u", "i", F.lit(None).cast("double").alias("rating"), F.lit(True).alias("target"))
        rows = settled(rows.unionByName(asked).groupBy("u", "i").agg(F.max("rating").alias("rating"), F.max("target").alias("target")))
        release(spark)
    rows = rows.join(items.drop("n"), "i", "left")
    rated = F.col("rating").isNotNull() & F.col("i").isNotNull()
    of = rows.groupBy("u").agg(
        F.array_sort(F.collect_list(F.when(rated, F.struct("i", "rating", "mean", "target", "before")))).alias("x"), F.avg("rating").alias("user_mean"), F.count("rating").alias("n"),
        F.collect_list(F.when(~rated & F.col("target"), F.struct("i", "rating", "mean", "before"))).alias("t"),
    )
    of = settled(of.withColumn("user_mean", F.when(F.col("u").isNotNull(), F.col("user_mean"))))
    release(spark)
    known = F.col("u").isNotNull()
    asks, asks_more = known & (F.col("n") - 1 > min_neighbors), known & (F.col("n") > F.lit(max(min_neighbors, 0)))
    plain = of.select("u", "user_mean", F.inline(F.concat(
        F.transform(F.filter("x", lambda x: x.target & ~asks), lambda x: F.struct(x.i.alias("i"), x.rating.alias("rating"), x["mean"].alias("mean"))),
        F.transform(F.filter("t", lambda t: ~(asks_more & t["mean"].isNotNull())), lambda t: F.struct(t.i.alias("i"), t.rating.alias("rating"), t["mean"].alias("mean"))),
    )))
    plain = plain.select("u", "i", "rating", F.col("mean").alias("item_mean"), "user_mean", F.coalesce("mean", "user_mean", F.lit(0.0)).alias("prediction"))
    columns = ["u", "i", "prediction", *(["rating", "item_mean", "user_mean"] if more else [])]
    dealt = of.where(known).withColumn("t", F.filter("t", lambda t: asks_more & t["mean"].isNotNull()))
    if dealt.where((F.size("t") > 0) | (asks & F.exists("x", lambda x: x.target))).isEmpty():
        return plain.select(*columns)

    held = dealt.select("u", "user_mean", asks.alias("asks"), F.col("x.i").alias("i"), F.col("x.rating").alias("r"), F.col("x.mean").alias("m"), F.col("x.target").alias("g"), F.col("x.before").alias("at"), "t", F.col("t.before").alias("to"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    for last in (False, False, True):
        placed = held.withColumns({c: F.transform(c, lambda x: F.floor(x * n / total).cast("int")) for c in ("at", "to")})
        copies = placed.agg(F.sum(F.size("i") * F.size(F.array_distinct(F.concat("at", "to"))))).first()[0]
        if last or copies <= n * _HELD:
            break
        n *= -(-copies // (n * _HELD))
    parts = -(-copies // (_COPIES * total))
    apart = items.count() * n < copies  # then the means cost less on their own than beside each rating
    kinds = dict(ratings.select("u", "i").dtypes)
    for part in range(parts):
        mine = lambda b: b % parts == part  # noqa: E731, B023
        rows = placed.withColumn("block", F.explode(F.filter(F.array_distinct(F.concat("at", "to")), mine)))
        rows = rows.withColumn("t", F.filter("t", lambda t, k: F.get("to", k) == F.col("block")))
        rows = rows.select(
            "u", "user_mean", "asks", "block", "i", "r", (F.slice("m", 1, 0) if apart else F.col("m")).alias("m"), "g", F.col("t.i").alias("ti"), F.col("t.mean").alias("tm"),
            (F.array_position("at", F.col("block")) - 1).alias("k"), F.array_position(F.reverse("at"), F.col("block")).alias("own"), F.size("at").alias("size"),
        )
        rows = rows.withColumn("own", F.when(F.col("k") < 0, 0).otherwise(F.col("size") - F.col("own") + 1 - F.col("k"))).drop("size")  # places stand in order
        if apart:
            told = items.groupBy(F.floor(F.col("before") / (1 << 16))).agg(F.collect_list("i").alias("i"), F.collect_list("mean").alias("r"))
            told = told.select(*[F.lit(None).cast(t).alias(c) if c not in ("i", "r") else F.col(c) for c, t in rows.dtypes if c != "block"], F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), mine)).alias("block"))
            rows = rows.unionByName(told)
        found = rows.repartitionById(-(-n // parts), F.floor(F.col("block") / parts).cast("int"))
        found = found.mapInArrow(_ranges_predicted, f"u {kinds['u']}, i {kinds['i']}, rating double, item_mean double, user_mean double, prediction double").select(*columns)
        if parts > 1:
            found = settled(found)
            release(spark)
        plain = plain.select(*columns).unionByName(found)
    return plain


def item_first(item: Column, user: Column, overall: Column) -> Column:
    """The item's mean, else the user's, else the overall mean."""
    return F.coalesce(item, user, overall)


def user_first(item: Column, user: Column, overall: Column) -> Column:
    return F.coalesce(user, item, overall)


def with_fallbacks(ratings: DataFrame, targets: DataFrame) -> DataFrame:
    """(u, i, item_first, user_first, item_count): fallback ladders for means, and for counts (item's, else user's, else
    the mean count of an item)."""
    items, users = averages(ratings, "i", "im").withColumnRenamed("n", "ic"), averages(ratings, "u", "um").withColumnRenamed("n", "uc")
    overall = ratings.agg(F.avg("rating").alias("g"), (F.count("*") / F.countDistinct("i")).alias("gc"))
    rows = targets.select("u", "i").distinct().join(items, "i", "left").join(users, "u", "left").crossJoin(F.broadcast(overall))  # one row
    return rows.select("u", "i", item_first(F.col("im"), F.col("um"), F.col("g")).alias("item_first"), user_first(F.col("im"), F.col("um"), F.col("g")).alias("user_first"), F.coalesce(F.col("ic").cast("double"), F.col("uc").cast("double"), F.col("gc")).alias("item_count"))


def activity(checkins: DataFrame, tips: DataFrame, photos: DataFrame) -> DataFrame:
    """(i, checkin_mean, tips, photos): mean check-ins of an item from rows (i, n), its tips and its photos counted; null
    where there are none."""
    out = checkins.groupBy("i").agg(F.avg("n").alias("checkin_mean"))
    out = out.join(tips.groupBy("i").agg(F.count("*").alias("tips")), "i", "full")
    return out.join(photos.groupBy("i").agg(F.count("*").alias("photos")), "i", "full")


def with_activity(targets: DataFrame, found: DataFrame) -> DataFrame:
    """(i, checkin_mean, tips, photos) of all targets (i): what an item lacks is the mean over the items that have it."""
    names = ["checkin_mean", "tips", "photos"]
    means = found.agg(*[F.avg(c).alias(f"_{c}") for c in names])
    rows = targets.select("i").distinct().join(found, "i", "left").crossJoin(F.broadcast(means))  # one row
    return rows.select("i", *[F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")).alias(c) for c in names])


def baseline_predict(ratings: DataFrame, targets: DataFrame) -> DataFrame:
    """(u, i, baseline): overall mean plus the user's and the item's offsets from it; unknown ones have none."""
    overall = ratings.agg(F.avg("rating").alias("g"))
    rows = targets.select("u", "i").distinct().join(averages(ratings, "i", "im").drop("n"), "i", "left").join(averages(ratings, "u", "um").drop("n"), "u", "left").crossJoin(F.broadcast(overall))
    return rows.select("u", "i", with_offsets(F.col("g"), F.col("um"), F.col("im")).alias("baseline"))


def with_offsets(overall: Column, *means: Column) -> Column:
    """The overall mean plus what each mean differs from it; an unknown one does not."""
    return sum((F.coalesce(m - overall, F.lit(0.0)) for m in means), overall)


def baseline_hybrid(ratings: DataFrame, min_neighbors: int = 60, cf_weight: float = 0.05) -> DataFrame:
    """(u, i, prediction) of every rating: the baseline's and the collaborative prediction blended as they are made, without a join."""
    rows = cf_predict(ratings, ratings, min_neighbors, more=True).where("u is not null and i is not null")
    rows = rows.crossJoin(F.broadcast(ratings.agg(F.avg("rating").alias("g"))))  # one row
    return rows.select("u", "i", blend(with_offsets(F.col("g"), F.col("user_mean"), F.col("item_mean")), F.col("prediction"), cf_weight).alias("prediction"))


def blend(model: Column, cf: Column, cf_weight: float = 0.05) -> Column:
    """Weighted mean of a model's and the collaborative prediction."""
    return (1 - cf_weight) * model + cf_weight * cf


def hybrid(model: DataFrame, cf: DataFrame, column: str, cf_weight: float = 0.05) -> DataFrame:
    """(u, i, prediction): both predictions joined on user and item, never by position."""
    return model.join(cf, ["u", "i"]).select("u", "i", blend(F.col(column), F.col("prediction"), cf_weight).alias("prediction"))


def histogram(scores: DataFrame, column: str) -> DataFrame:
    """(bucket, n): scores in [..1), [1, 2), [2, 3), [3, 4), [4 ..)."""
    return scores.groupBy(bucketed(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))


def features(ratings: DataFrame, users: DataFrame, items: DataFrame, imputed: bool = True) -> DataFrame:
    """``ratings`` with the columns of ``users`` (keyed u) and ``items`` (keyed i); what an unknown user or item lacks is
    the mean of that column over the rated rows."""
    names = [c for c in users.columns if c != "u"] + [c for c in items.columns if c != "i"]
    rows = ratings.join(users, "u", "left").join(items, "i", "left")
    return _imputed(rows, names) if imputed else rows


def _imputed(rows: DataFrame, names: list[str]) -> DataFrame:
    means = rows.agg(*[F.avg(c).alias(f"_{c}") for c in names])
    rows = rows.crossJoin(F.broadcast(means))  # one row
    return rows.select(*[c for c in rows.columns if c not in names and c[1:] not in names], *[F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")).alias(c) for c in names])


def features_once(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``features``, joined only once."""
    rows = settled(features(ratings, users, items, imputed=False))
    release(ratings.sparkSession)
    return _imputed(rows, [c for c in users.columns if c != "u"] + [c for c in items.columns if c != "i"])


def boosted(train: DataFrame, columns: list[str], label: str = "rating", depth: int = 5, trees: int = 20, rate: float = 0.1, subsample: float = 0.5, columns_share: str = "0.5", gain: float = 0.0, least: int = 3, seed: int = 1, weight: str | None = None):
    """A pipeline of boosted regression trees over feature columns, fitted. ``columns_share`` of the columns are looked at for
    a split, which has to gain ``gain`` at least; a large ensemble is ``depth=10, trees=1500, rate=0.01``. With ``weight`` a row
    stands for so many rows, of which a leaf has ``least`` at least."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep")
    trees_ = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="model", maxDepth=depth, maxIter=trees, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=columns_share, minInfoGain=gain, minInstancesPerNode=least, seed=seed)
    if weight:
        trees_ = trees_.setWeightCol(weight).setMinInstancesPerNode(1).setMinWeightFractionPerNode(min(0.49, least / (train.agg(F.sum(weight)).first()[0] or 1)))
    return Pipeline(stages=[assembler, trees_]).fit(train)


def boosted_by_cell(train: DataFrame, columns: list[str], label: str = "rating", bins: int = 32, **parameters) -> Callable[[DataFrame], DataFrame]:
    """``boosted`` over columns cut at quantiles of all rows, as the trees cut them anyway; what tells rows with ``model``. Rows that agree in
    all cuts and the label are learnt from as one row that weighs as many, and are in or out of a tree's subsample together."""
    cuts = [sorted(set(x)) for x in train.approxQuantile(columns, [k / bins for k in range(1, bins)], 1 / (8 * bins))]
    names = [f"_{c}" for c in columns]
    cells = lambda rows: rows.withColumns({n: _block(F.col(c), x) for n, c, x in zip(names, columns, cuts, strict=True)})
    groups = settled(cells(train).groupBy(*names, label).agg(F.count("*").cast("double").alias("_weight")))
    release(train.sparkSession)
    model = boosted(groups, names, label, weight="_weight", **parameters)
    return lambda rows: model.transform(cells(rows)).drop(*names)


def factorised(train: DataFrame, rank: int = 10, rounds: int = 10, penalty: float = 0.1, seed: int = 1):
    """A model of (u, i, rating) by alternating least squares, as an alternative to the neighbourhood predictions; integer
    ids. Unknown users and items get no prediction."""
    from pyspark.ml.recommendation import ALS

    return ALS(userCol="u", itemCol="i", ratingCol="rating", rank=rank, maxIter=rounds, regParam=penalty, coldStartStrategy="nan", seed=seed).fit(train)


def text_profile(texts: DataFrame, key: str) -> DataFrame:
    """(key, length_mode, stars_mean, useful_median, funny_mode, cool_mode) from (key, text, stars, useful, funny, cool);
    of several most frequent values the largest."""
    rows = texts.withColumn("length", F.length("text"))
    out = rows.groupBy(key).agg(F.avg("stars").alias("stars_mean"), F.median("useful").alias("useful_median"))
    for value, name in (("length", "length_mode"), ("funny", "funny_mode"), ("cool", "cool_mode")):
        n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
        out = out.join(n.groupBy(key).agg(F.max_by(value, F.struct("n", value)).alias(name)), key)
    return out


def sentiment(texts: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, mean): the mean score over the words of all texts of a key, words not in ``lexicon`` (word, score) counting 0;
    0 without words."""
    words = texts.select(key, F.explode_outer(F.split(F.lower("text"), "[^a-zà-ÿ]+")).alias("word"))
    scored = words.join(F.broadcast(lexicon), "word", "left")  # a word list
    real = F.coalesce(F.col("word") != "", F.lit(False))
    return scored.groupBy(key).agg(F.coalesce(F.sum(F.when(real, F.coalesce("score", F.lit(0.0)))) / F.sum(F.when(real, 1)), F.lit(0.0)).alias("mean"))
