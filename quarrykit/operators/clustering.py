"""Clustering of large point sets by summaries: N, SUM and SUMSQ of each cluster (BFR), on (id, features).

Points are taken in chunks. A chunk is assigned against the summaries as they stood before it, all points at once (a
sequential reader updates them after every point). Points near no discard cluster go to compression clusters, points
near none of either stay retained and are clustered again with the next chunk. Only summaries, a row for each
cluster, ever reach the driver.
"""

from __future__ import annotations

from math import sqrt

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..functions.ranking import numbered


def chunked(points: DataFrame, chunks: int, salt: int = 10) -> DataFrame:
    """``points`` with a chunk number from 0: shuffled by an arithmetic hash of the id and cut evenly, the last chunk
    taking the remainder."""
    h = (F.col("id").cast("long") * 48271 + salt * 69621 + 12345) % 2147483647
    n = points.count()
    size = max(1, n // chunks)
    rows = numbered(points.withColumn("_h", h), F.expr("_h div 2097152"), ["_h", "id"], "_seq")
    return rows.withColumn("chunk", F.least(F.expr(f"_seq div {size}"), F.lit(chunks - 1)).cast("int")).drop("_h", "_seq")


def summaries(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, sum, sumsq): a row for each cluster, sums by dimension as arrays."""
    long = points.select(cluster, F.posexplode("features").alias("dim", "x"))
    by_dim = long.groupBy(cluster, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = by_dim.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return whole.select(cluster, "n", F.transform("d", lambda x: x["s"]).alias("sum"), F.transform("d", lambda x: x["q"]).alias("sumsq"))


def mahalanobis(features: str, n: str, total: str, squares: str) -> Column:
    """Distance of a point from a summary, each dimension scaled by the cluster's deviation. A dimension without spread
    adds nothing at its mean and puts any other point out of reach."""
    terms = f"transform(arrays_zip({features}, {total}, {squares}), x -> struct(x.{features} - x.{total} / {n} as gap, greatest(x.{squares} / {n} - pow(x.{total} / {n}, 2), 0D) as var))"
    return F.expr(f"sqrt(aggregate({terms}, 0D, (a, t) -> a + case when t.var > 1e-12 then t.gap * t.gap / t.var when abs(t.gap) < 1e-9 then 0D else 1e18 end))")


def nearest(points: DataFrame, clusters: DataFrame, limit: float | None = None) -> DataFrame:
    """(id, cluster, distance): the nearest cluster of each point, ties to the smallest; with ``limit`` only those below."""
    pairs = points.select("id", "features").crossJoin(F.broadcast(clusters))  # a row for each cluster
    near = pairs.withColumn("distance", mahalanobis("features", "n", "sum", "sumsq")).groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("m"))
    rows = near.select("id", "m.cluster", "m.distance")
    return rows.where(F.col("distance") < limit) if limit is not None else rows


def kmeans(points: DataFrame, k: int, seed: int = 10) -> DataFrame:
    """(id, features, cluster) by the built-in k-means; as many clusters as there are points if those are fewer."""
    n = points.count()
    if n == 0:
        return points.select("id", "features", F.lit(0).alias("cluster"))
    if min(n, k) < 2:
        return points.select("id", "features", F.lit(0).alias("cluster"))
    model = KMeans(k=min(n, k), seed=seed, maxIter=20, featuresCol="_v", predictionCol="cluster").fit(rows := points.withColumn("_v", array_to_vector("features")))
    return model.transform(rows).select("id", "features", "cluster")


def lloyd(points: DataFrame, k: int, rounds: int) -> DataFrame:
    """(id, cluster) after fixed rounds of k-means seeded with the k smallest ids; ties to the smaller cluster."""
    start = points.orderBy("id").limit(k).select("id", "features")
    centres = settled(numbered(start, F.col("id"), ["id"], "cluster").select("cluster", F.col("features").alias("centre")))
    for r in range(rounds):
        pairs = points.select("id", "features").crossJoin(F.broadcast(centres))  # k rows
        gap = F.expr("aggregate(zip_with(features, centre, (x, y) -> (x - y) * (x - y)), 0D, (a, b) -> a + b)")
        own = pairs.withColumn("gap", F.round(gap, 9)).groupBy("id").agg(F.min(F.struct("gap", "cluster")).alias("m")).select("id", "m.cluster")
        if r < rounds - 1:
            sums = summaries(points.join(own, "id"))
            centres = settled(sums.select("cluster", F.expr("transform(sum, x -> x / n)").alias("centre")))
    return own


def cluster_distance(clusters: DataFrame) -> DataFrame:
    """(a, b, distance) of every pair of summaries: the smaller of both centres' distances from the other cluster."""
    left = clusters.select(F.col("cluster").alias("a"), F.col("n").alias("na"), F.col("sum").alias("sa"), F.col("sumsq").alias("qa"), F.expr("transform(sum, x -> x / n)").alias("ca"))
    right = clusters.select(F.col("cluster").alias("b"), F.col("n").alias("nb"), F.col("sum").alias("sb"), F.col("sumsq").alias("qb"), F.expr("transform(sum, x -> x / n)").alias("cb"))
    pairs = left.join(F.broadcast(right), F.col("a") < F.col("b"))  # a row for each cluster
    return pairs.select("a", "b", F.least(mahalanobis("ca", "nb", "sb", "qb"), mahalanobis("cb", "na", "sa", "qa")).alias("distance"))


def _split_singletons(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    alone = rows.groupBy("cluster").agg(F.count("*").alias("c")).where("c = 1").select("cluster")
    return rows.join(F.broadcast(alone), "cluster", "left_anti"), rows.join(F.broadcast(alone), "cluster", "left_semi")  # a row for each cluster


def _merged(members: DataFrame, limit: float) -> DataFrame:
    """Compression clusters that lie within ``limit`` of each other become one, nearest pairs first, until none do."""
    while True:
        close = cluster_distance(summaries(members)).where(F.col("distance") < limit).orderBy("distance", "a", "b").limit(1).collect()
        if not close:
            return members
        a, b = close[0].a, close[0].b
        members = settled(members.withColumn("cluster", F.when(F.col("cluster") == b, F.lit(a)).otherwise(F.col("cluster"))))


def bfr(points: DataFrame, k: int, chunks: int = 5, factor: float = 2.0, seed: int = 10) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) with -1 for points that stay retained, and (round, n_ds, n_ccs, n_cs, n_rs) after each chunk.

    Clusters of the discard set are 0 .. k - 1; points of compression clusters left at the end go to the discard cluster
    within ``factor`` * sqrt(dimensions) or keep a number of their own from 1000 upwards.
    """
    spark = points.sparkSession
    empty = spark.createDataFrame([], "round int, n_ds long, n_ccs long, n_cs long, n_rs long")
    first = points.select(F.size("features").alias("d")).first()
    if first is None:
        return points.select("id", F.lit(-1).alias("cluster")), empty
    limit = factor * sqrt(first.d)
    dealt = settled(chunked(points.select("id", "features"), chunks))
    start = dealt.where("chunk = 0").drop("chunk")
    dense, rs = _split_singletons(settled(kmeans(start, 5 * k, seed)))
    ds = settled(kmeans(dense.drop("cluster"), k, seed))
    rs = settled(rs.drop("cluster"))
    cs = settled(ds.limit(0))
    report, next_id = [], 1000

    def recluster(rs: DataFrame, cs: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame, int]:
        n = rs.count()
        if n < 2:
            return rs, cs, next_id
        groups, alone = _split_singletons(settled(kmeans(rs, min(5 * k, max(1, int(0.9 * n))), seed)))
        new = settled(groups.withColumn("cluster", F.col("cluster") + next_id).select("id", "features", "cluster"))
        return settled(alone.select("id", "features")), settled(cs.unionByName(new)), next_id + 5 * k

    for r in range(chunks):
        if r:
            chunk = dealt.where(F.col("chunk") == r).drop("chunk")
            to_ds = settled(nearest(chunk, summaries(ds), limit))
            rest = chunk.join(to_ds, "id", "left_anti")
            to_cs = settled(nearest(rest, summaries(cs), limit))
            ds = settled(ds.unionByName(chunk.join(to_ds, "id").select("id", "features", "cluster")))
            cs = settled(cs.unionByName(rest.join(to_cs, "id").select("id", "features", "cluster")))
            rs = settled(rs.unionByName(rest.join(to_cs, "id", "left_anti").select("id", "features")))
        rs, cs, next_id = recluster(rs, cs, next_id)
        cs = _merged(cs, limit)
        if r == chunks - 1:
            centres = summaries(cs).select(F.col("cluster").alias("id"), F.expr("transform(sum, x -> x / n)").alias("features"))
            move = settled(nearest(centres, summaries(ds), limit).select(F.col("id").alias("from"), F.col("cluster").alias("to")))
            joined = cs.join(F.broadcast(move), F.col("cluster") == F.col("from"), "left")  # a row for each cluster
            moved = settled(joined.select("id", "features", F.coalesce("to", "cluster").alias("cluster")))
            ds = settled(ds.unionByName(moved.where("cluster < 1000")))
            cs = settled(moved.where("cluster >= 1000"))
        report.append((r + 1, ds.count(), cs.select("cluster").distinct().count(), cs.count(), rs.count()))
    labels = ds.select("id", "cluster").unionByName(cs.select("id", "cluster")).unionByName(rs.select("id", F.lit(-1).alias("cluster")))
    return labels, spark.createDataFrame(report, empty.schema)
