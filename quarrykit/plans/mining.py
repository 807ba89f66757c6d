"""Queries over the star schema, each with SQL that gives the same rows.

``QUERIES`` maps a name to (function of (spark, sf_dir), SQL or None). SQL is None where results depend on physical
layout, a trained model or a seeded library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.lineage import release, settled
from ..operators import clustering, graph, itemsets, recommend, relational, similarity, sketch
from ..sources import readers, sinks, views
from ..streaming import sketches as streams

QUERIES: dict = {}

_REVIEWS = "reviews as (select o_custkey u, l_suppkey i, cast(1 + cast(l_quantity as bigint) % 5 as double) stars, strftime(o_orderdate, '%Y-%m-%d') as day from lineitem join orders on l_orderkey = o_orderkey)"
_RATINGS = f"{_REVIEWS}, ratings as (select u, i, max(stars) rating from reviews group by 1, 2)"
_BASKETS = "baskets as (select distinct l_orderkey b, p_brand i from lineitem join part on l_partkey = p_partkey)"
_PAIRS = "ev as (select distinct cast(user_id as varchar) u, props v from events)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def joined(column: str, name: str):
    return F.array_join(F.col(column), "|").alias(name)


# Counts, rankings, averages


@query(f"with {_REVIEWS} select count(*) n_review, count(*) filter (where contains(day, '1998')) n_review_like, count(distinct u) n_user, count(distinct i) n_item from reviews")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return relational.review_summary(views.reviews(spark, d), "1998")


@query(f"with {_REVIEWS} select count(*) n from reviews")
def review_count(spark: SparkSession, d: str) -> DataFrame:
    return relational.count_rows(views.reviews(spark, d))


@query("select count(*) n from orders where contains(strftime(o_orderdate, '%Y-%m-%d'), '1998')")
def review_count_by_substring(spark: SparkSession, d: str) -> DataFrame:
    orders = views.table(spark, d, "orders")
    return relational.count_rows(orders.where(F.contains(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998"))))


@query("select count(*) n from orders where year(o_orderdate) = 1998")
def review_count_by_year(spark: SparkSession, d: str) -> DataFrame:
    return relational.count_rows(views.table(spark, d, "orders").where((F.col("o_orderdate") >= "1998-01-01") & (F.col("o_orderdate") < "1999-01-01")))


@query("select count(distinct o_custkey) n from orders")
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return relational.distinct_count(views.table(spark, d, "orders"), "o_custkey")


@query("select count(distinct l_suppkey) n from lineitem")
def distinct_items(spark: SparkSession, d: str) -> DataFrame:
    return relational.distinct_count(views.table(spark, d, "lineitem"), "l_suppkey")


@query(f"with {_REVIEWS} select u, count(*) n from reviews group by 1 order by n desc, u limit 10")
def top_users(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(views.reviews(spark, d), "u")


@query("select l_suppkey i, count(*) n from lineitem group by 1 order by n desc, i limit 10")
def top_items(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_k(views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i")), "i")


@query("with c as (select o_custkey u, count(*) n from orders group by 1) select u, n from c where n = (select max(n) from c) order by u limit 10")
def tied_top_users(spark: SparkSession, d: str) -> DataFrame:
    return relational.tied_top(views.table(spark, d, "orders").select(F.col("o_custkey").alias("u")), "u")


@query("select l_suppkey i, count(*) n from lineitem group by 1 order by n, i desc limit 10")
def bottom_items(spark: SparkSession, d: str) -> DataFrame:
    return relational.bottom_k(views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i")), "i")


def _averages(spark: SparkSession, d: str, nations: int | None) -> DataFrame:
    out = relational.average_by_dimension(views.reviews(spark, d), views.business(spark, d, nations), "i", "item", "city", "stars")
    return out.withColumn("average", F.round("average", 6))


_CITY = "from reviews left join (select s_suppkey item, n_name city from supplier join nation on s_nationkey = n_nationkey{}) x on i = item"


@query(f"with {_REVIEWS} select city, round(avg(stars), 6) average {_CITY.format('')} group by 1")
def avg_rating_by_city(spark: SparkSession, d: str) -> DataFrame:
    return _averages(spark, d, None)


@query(f"with {_REVIEWS} select city, round(avg(stars), 6) average {_CITY.format(' where s_nationkey < 20')} group by 1")
def avg_rating_by_city_nulls(spark: SparkSession, d: str) -> DataFrame:
    return _averages(spark, d, 20)


@query(f"with {_REVIEWS} select city, round(avg(stars), 6) average {_CITY.format('')} group by 1 order by avg(stars) desc, city limit 10")
def top_cities(spark: SparkSession, d: str) -> DataFrame:
    return _averages(spark, d, None).limit(10)


@query(f"with {_REVIEWS} select city, count(*) n, cast(sum(stars) as double) s, round(sum(stars) / count(*), 6) average {_CITY.format(' where s_nationkey < 20')} group by 1")
def city_avg_two_aggregates(spark: SparkSession, d: str) -> DataFrame:
    out = relational.average_of_two_aggregates(views.reviews(spark, d), views.business(spark, d, 20), "i", "item", "city", "stars")
    return out.withColumn("average", F.round("average", 6))


@query(None)
def partition_profile_default(spark: SparkSession, d: str) -> DataFrame:
    return relational.partition_profile(views.reviews(spark, d), "i", 8)


@query("select cast(ascii(cast(l_suppkey as varchar)) % 8 as int) part, count(*) \"rows\" from lineitem group by 1")
def partition_profile_custom(spark: SparkSession, d: str) -> DataFrame:
    return relational.partition_profile(views.table(spark, d, "lineitem"), "l_suppkey", 8, relational.first_character("l_suppkey"))


# Itemsets


def _frequent_sql(baskets: str, need: str, names: str = "items, support", tail: str = "") -> str:
    """Frequent itemsets of all sizes from a relation (b, i): occurrences of a set are taken one item further as long as the
    longer set is frequent."""
    return f"""with recursive {baskets}, need as (select {need} s),
        r as (select b, i from baskets where i in (select i from baskets group by 1 having count(*) >= (select s from need))),
        o as (select b, [i] t, i last from r
              union all select b, t, last from (select x.b, list_append(x.t, r.i) t, r.i last, count(*) over (partition by list_append(x.t, r.i)) n
                                                from o x join r on x.b = r.b and r.i > x.last) where n >= (select s from need)),
        f as (select array_to_string(t, '|') items, count(*) support, len(t) size from o group by t)
        select {names} from f {tail}"""


_SHARE = "cast(ceil({} * (select count(distinct b) from baskets)) as bigint)"
_USERS = f"{_PAIRS}, baskets as (select u b, v i from ev)"
_VALUES = f"{_PAIRS}, baskets as (select v b, u i from ev)"


def _users_as_baskets(spark: SparkSession, d: str) -> DataFrame:
    return views.event_pairs(spark, d).select(F.col("user").alias("b"), F.col("value").alias("i"))


def _values_as_baskets(spark: SparkSession, d: str) -> DataFrame:
    return views.event_pairs(spark, d).select(F.col("value").alias("b"), F.col("user").alias("i"))


def _sets(found: DataFrame) -> DataFrame:
    return found.select(joined("items", "items"), "support")


@query("select p_brand i, count(*) support from lineitem join part on l_partkey = p_partkey group by 1")
def item_support(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = views.table(spark, d, "lineitem").select("l_partkey"), views.table(spark, d, "part").select("p_partkey", "p_brand")
    return itemsets.supports(lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("p_brand").alias("i")))


@query(f"with {_REVIEWS} select u, count(*) support from reviews group by 1")
def user_support(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.supports(views.reviews(spark, d), "u")


@query(f"with {_PAIRS} select u \"user\", string_agg(v, '|' order by v) items from ev group by 1")
def baskets_by_user(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.as_sets(views.event_pairs(spark, d), "user", "value").select("user", joined("items", "items"))


@query(f"with {_PAIRS} select v \"value\", string_agg(u, '|' order by u) items from ev group by 1")
def baskets_by_item(spark: SparkSession, d: str) -> DataFrame:
    return itemsets.as_sets(views.event_pairs(spark, d), "value", "user").select("value", joined("items", "items"))


@query("with x as (select distinct strftime(o_orderdate, '%Y-%m-%d') || '-' || cast(o_custkey as varchar) b, l_partkey i from orders join lineitem on l_orderkey = o_orderkey) select b, string_agg(cast(i as varchar), '|' order by i) items from x group by 1 having count(*) > 3")
def date_customer_baskets(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = views.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), views.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    quoted = lambda c: scalar.clean_number(F.concat(F.lit('"000'), F.col(c).cast("string"), F.lit('"')))
    out = itemsets.date_customer_baskets(rows, F.date_format("o_orderdate", "yyyy-MM-dd"), quoted("o_custkey").cast("string"), quoted("l_partkey"), larger_than=3)
    return out.select("b", joined("items", "items"))


@query(_frequent_sql(_BASKETS, _SHARE.format("0.004")))
def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    baskets = views.order_baskets(spark, d)
    return _sets(itemsets.frequent(baskets, itemsets.threshold(baskets, 0.004)))


@query(_frequent_sql(_USERS, _SHARE.format("0.26")))
def frequent_itemsets_case1(spark: SparkSession, d: str) -> DataFrame:
    baskets = _users_as_baskets(spark, d)
    return _sets(itemsets.frequent(baskets, itemsets.threshold(baskets, 0.26)))


@query(_frequent_sql(_VALUES, _SHARE.format("0.32")))
def frequent_itemsets_case2(spark: SparkSession, d: str) -> DataFrame:
    baskets = _values_as_baskets(spark, d)
    return _sets(itemsets.frequent_by_kind(baskets, itemsets.threshold(baskets, 0.32)))


def _son_sql(chunks: int, share: float) -> str:
    """The candidates of each chunk of orders (order number modulo ``chunks``)."""
    parts = []
    for c in range(chunks):
        need = f"cast(ceil((select count(distinct b) from baskets) * cast((select ceil({share} * count(distinct b)) from orders_all) as double) / (select count(distinct b) from orders_all)) as bigint)"
        base = f"orders_all as (select distinct l_orderkey b, p_brand i from lineitem join part on l_partkey = p_partkey), baskets as (select b, i from orders_all where b % {chunks} = {c})"
        parts.append(f"select items from ({_frequent_sql(base, need, 'items')}) c{c}")
    return f"select distinct items from ({' union all '.join(parts)}) x"


@query(_son_sql(4, 0.004))
def son_candidates(spark: SparkSession, d: str) -> DataFrame:
    baskets = views.order_baskets(spark, d)
    return itemsets.son_candidates(baskets, itemsets.threshold(baskets, 0.004), 4, F.col("b")).select(joined("items", "items"))


@query(_frequent_sql(_BASKETS, _SHARE.format("0.004")))
def son_frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    baskets = views.order_baskets(spark, d)
    return _sets(itemsets.son(baskets, itemsets.threshold(baskets, 0.004), 4, F.col("b")))


@query(_frequent_sql(_BASKETS, _SHARE.format("0.004")))
def fpgrowth_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    baskets = views.order_baskets(spark, d)
    return _sets(itemsets.fp_growth(baskets, itemsets.threshold(baskets, 0.004)))


@query(f"with {_BASKETS}, need as (select {_SHARE.format('0.02')} s), f as (select i from baskets group by 1 having count(*) >= (select s from need)) select x.i a, y.i b, count(*) support from baskets x join baskets y on x.b = y.b and x.i < y.i where x.i in (select i from f) and y.i in (select i from f) group by 1, 2 having count(*) >= (select s from need)")
def frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    baskets = views.order_baskets(spark, d)
    return itemsets.frequent_pairs(baskets, itemsets.threshold(baskets, 0.02))


_SUPPLIERS = "baskets as (select distinct l_orderkey b, l_suppkey i from lineitem)"


@query(f"with {_SUPPLIERS}, need as (select {_SHARE.format('0.002')} s), p as (select x.i a, y.i b, (x.i * 31 + y.i * 17) % 1009 bucket from baskets x join baskets y on x.b = y.b and x.i < y.i), full_ as (select bucket, count(*) bucket_count from p group by 1 having count(*) >= (select s from need)) select a, b, bucket, bucket_count, count(*) support from p join full_ using (bucket) group by all having count(*) >= (select s from need)")
def pcy_pairs(spark: SparkSession, d: str) -> DataFrame:
    baskets = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_suppkey").alias("i")).distinct()
    return itemsets.pcy_pairs(baskets, itemsets.threshold(baskets, 0.002))


@query(_frequent_sql(_BASKETS, _SHARE.format("0.004"), "cast(size as int) size, string_agg('(''' || replace(items, '|', ''', ''') || ''')', ',' order by replace(items, '|', chr(1))) line", "group by size"))
def itemset_report(spark: SparkSession, d: str) -> DataFrame:
    baskets = views.order_baskets(spark, d)
    return sinks.itemset_lines(itemsets.frequent(baskets, itemsets.threshold(baskets, 0.004)))


# Similarity

_SETS = "sets as (select distinct user_id item, strftime(ts, '%Y-%m-%d') || '|' || event_type element from events), idx as (select element, cast(row_number() over (order by element) - 1 as bigint) idx from (select distinct element from sets)), m as (select item, idx from sets join idx using (element))"
_HASHES = "h as (select j, 7919 * (j + 1) % 104729 a, 1299709 * (j + 3) % 15485863 b from range(100) t(j)), sig as (select item, j, min((idx * a + b) % (select count(*) from idx)) s from m, h group by 1, 2)"
_BANDS = "bands as (select item, j // 2 band, string_agg(cast(s as varchar), ',' order by j) k from sig group by 1, 2), cand as (select distinct x.item a, y.item b from bands x join bands y on x.band = y.band and x.k = y.k and x.item < y.item)"
_JACCARD = "sizes as (select item, count(*) n from sets group by 1), ov as (select x.item a, y.item b, count(*) c from sets x join sets y on x.element = y.element and x.item < y.item group by 1, 2), jac as (select a, b, c / (p.n + q.n - c) sim from ov join sizes p on a = p.item join sizes q on b = q.item)"


@query(f"with {_SETS} select element, idx from idx")
def element_index(spark: SparkSession, d: str) -> DataFrame:
    return similarity.element_index(views.event_sets(spark, d))


@query(f"with {_SETS} select item, string_agg(cast(idx as varchar), '|' order by idx) members from m group by 1")
def characteristic_matrix(spark: SparkSession, d: str) -> DataFrame:
    return similarity.characteristic_matrix(views.event_sets(spark, d)).select("item", joined("members", "members"))


@query(f"with {_SETS}, {_HASHES} select item, string_agg(cast(s as varchar), '|' order by j) sig from sig group by 1")
def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return similarity.signatures(views.event_sets(spark, d)).select("item", joined("sig", "sig"))


@query(f"with {_SETS}, {_HASHES}, {_BANDS} select a, b from cand")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return similarity.candidate_pairs(views.event_sets(spark, d))


@query(f"with {_SETS}, {_JACCARD} select a, b, round(sim, 6) similarity from jac where sim >= 0.3")
def jaccard_pairs_exact(spark: SparkSession, d: str) -> DataFrame:
    return similarity.exact_pairs(views.event_sets(spark, d), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"with {_SETS}, {_HASHES}, {_BANDS}, {_JACCARD} select a, b, round(sim, 6) similarity from jac join cand using (a, b) where sim >= 0.3")
def lsh_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_pairs(views.event_sets(spark, d), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(None)
def minhash_mllib(spark: SparkSession, d: str) -> DataFrame:
    return similarity.mllib_pairs(views.event_sets(spark, d), 0.3)


# Recommendation

_MEANS = f"{_RATINGS}, im as (select i, avg(rating) im, count(*) ic from ratings group by 1), um as (select u, avg(rating) um, count(*) un from ratings group by 1)"
_SIM = "z as (select r.u, r.i, rating - im z from ratings r join im on r.i = im.i), sim as (select x.i a, y.i b, case when sqrt(sum(x.z * x.z) * sum(y.z * y.z)) = 0 then 0 else sum(x.z * y.z) / sqrt(sum(x.z * x.z) * sum(y.z * y.z)) end s from z x join z y on x.u = y.u and x.i < y.i group by 1, 2), near as (select a, b, s from sim where s > 0 union all select b, a, s from sim where s > 0)"


def _cf_sql(least: int, targets: str = "select u, i from ratings") -> str:
    return f"{_MEANS}, {_SIM}, t as (select distinct u, i from ({targets}) q), k as (select t.u, t.i, im, um, un - case when r.u is null then 0 else 1 end others from t left join im on t.i = im.i left join um on t.u = um.u left join ratings r on r.u = t.u and r.i = t.i), up as (select k.u, k.i, sum(s * rating) up, sum(s) down from k join ratings r on r.u = k.u and r.i <> k.i join near on near.a = k.i and near.b = r.i where im is not null and others > {least} group by 1, 2), cf as (select k.u, k.i, coalesce(case when up * down <> 0 then up / down end, im, um, 0) prediction from k left join up on up.u = k.u and up.i = k.i)"


@query(f"with {_MEANS} select i, round(im, 6) average, ic n from im")
def item_averages(spark: SparkSession, d: str) -> DataFrame:
    return recommend.averages(views.ratings(spark, d), "i").withColumn("average", F.round("average", 6))


@query(f"with {_MEANS} select u, round(um, 6) average, un n from um")
def user_averages(spark: SparkSession, d: str) -> DataFrame:
    return recommend.averages(views.ratings(spark, d), "u").withColumn("average", F.round("average", 6))


@query(f"with {_RATINGS} select round(avg(rating), 6) average from ratings")
def global_average(spark: SparkSession, d: str) -> DataFrame:
    return recommend.global_average(views.ratings(spark, d)).select(F.round("average", 6).alias("average"))


@query(f"with {_MEANS}, {_SIM} select a, b, round(s, 6) similarity from sim")
def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    return recommend.pearson(_ratings(spark, d)).withColumn("similarity", F.round("similarity", 6))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """The ratings, computed once."""
    found = settled(views.ratings(spark, d))
    release(spark)
    return found


def _predictions(spark: SparkSession, d: str, least: int) -> DataFrame:
    r = _ratings(spark, d)
    return recommend.cf_predict(r, r, least)


@query(f"with {_cf_sql(20)} select u, i, round(prediction, 6) prediction from cf")
def cf_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d, 20).withColumn("prediction", F.round("prediction", 6))


@query(f"with {_cf_sql(60)} select u, i, round(prediction, 6) prediction from cf")
def cf_predictions_60(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d, 60).withColumn("prediction", F.round("prediction", 6))


_COLD = "select u, -1 i from (select distinct u from reviews) x union all select -1, i from (select distinct i from reviews) y union all select -1, -1"


def _cold(r: DataFrame) -> DataFrame:
    none = F.lit(-1).cast("long")
    one = r.sparkSession.range(1).select(none.alias("u"), none.alias("i"))
    return r.select("u", none.alias("i")).unionByName(r.select(none.alias("u"), "i")).unionByName(one).distinct()


@query(f"with {_cf_sql(20, _COLD)} select u, i, round(prediction, 6) prediction from cf")
def cf_cold_start(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    return recommend.cf_predict(r, _cold(r), 20).withColumn("prediction", F.round("prediction", 6))


@query(f"with {_cf_sql(20)} select round(sqrt(avg(pow(rating - prediction, 2))), 6) rmse from cf join ratings r on r.u = cf.u and r.i = cf.i")
def cf_rmse(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    return relational.rmse(recommend.cf_predict(r, r, 20, more=True).where("u is not null and i is not null"), "rating", "prediction").select(F.round("rmse", 6).alias("rmse"))


@query(f"with {_MEANS}, t as (select distinct u, i from (select u, i from ratings union all {_COLD}) q), g as (select avg(rating) g, count(*) / count(distinct i) gc from ratings) select t.u, t.i, round(coalesce(im, um, g), 6) item_first, round(coalesce(um, im, g), 6) user_first, round(coalesce(ic, un, gc), 6) item_count from t left join im on t.i = im.i left join um on t.u = um.u, g")
def star_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    rows = recommend.with_fallbacks(r, r.select("u", "i").unionByName(_cold(r)))
    return rows.select("u", "i", *[F.round(c, 6).alias(c) for c in ("item_first", "user_first", "item_count")])


_USER4 = "uf as (select o_custkey u, cast(count(*) as double) review_count, avg(o_totalprice) average_stars from orders group by 1), bf as (select l_suppkey i, avg(l_quantity) stars, cast(count(*) as double) b_review_count from lineitem group by 1)"


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = views.table(spark, d, "orders"), views.table(spark, d, "lineitem")
    users = orders.groupBy(F.col("o_custkey").alias("u")).agg(F.count("*").cast("double").alias("review_count"), F.avg("o_totalprice").alias("average_stars"))
    items = lines.groupBy(F.col("l_suppkey").alias("i")).agg(F.avg("l_quantity").alias("stars"), F.count("*").cast("double").alias("b_review_count"))
    return users, items


def _rounded(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("u", "i", *[F.round(c, 6).alias(c) for c in names])


@query(f"with {_RATINGS}, {_USER4} select r.u, r.i, rating, round(review_count, 6) review_count, round(average_stars, 6) average_stars, round(stars, 6) stars, round(b_review_count, 6) b_review_count from ratings r left join uf on r.u = uf.u left join bf on r.i = bf.i")
def features4(spark: SparkSession, d: str) -> DataFrame:
    rows = recommend.features(views.ratings(spark, d), *_profiles(spark, d), imputed=False)
    return _rounded(rows, ["rating", "review_count", "average_stars", "stars", "b_review_count"])


_FEATURES14 = ["uf1", "uf2", "uf3", "uf4", "uf5", "uf6", "uf7", "uf8", "bf1", "bf2", "bf3", "bf4", "bf5", "tip"]
_USER14 = "uf as (select o_custkey u, cast(count(*) as double) uf1, avg(o_totalprice) uf2, max(o_totalprice) uf3, min(o_totalprice) uf4, cast(count(*) filter (where o_orderstatus = 'F') as double) uf5, cast(count(*) filter (where o_orderstatus = 'O') as double) uf6, cast(count(distinct o_orderpriority) as double) uf7, max(c_acctbal) uf8 from orders join customer on o_custkey = c_custkey group by 1), bf as (select l_suppkey i, avg(l_quantity) bf1, cast(count(*) as double) bf2, avg(l_discount) bf3, avg(l_tax) bf4, cast(max(case when s_acctbal > 0 then 1 else 0 end) as double) bf5, avg(l_extendedprice) tip from lineitem join (select * from supplier where s_nationkey < 20) s on l_suppkey = s_suppkey group by 1)"


def _profiles14(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders, customers = views.table(spark, d, "orders"), views.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    lines, suppliers = views.table(spark, d, "lineitem"), views.table(spark, d, "supplier").where("s_nationkey < 20").select("s_suppkey", "s_acctbal")
    price = F.col("o_totalprice")
    users = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(F.col("o_custkey").alias("u")).agg(
        F.count("*").cast("double").alias("uf1"), F.avg(price).alias("uf2"), F.max(price).alias("uf3"), F.min(price).alias("uf4"),
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("uf5"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("uf6"),
        F.countDistinct("o_orderpriority").cast("double").alias("uf7"), F.max("c_acctbal").alias("uf8"),
    )
    items = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).groupBy(F.col("l_suppkey").alias("i")).agg(
        F.avg("l_quantity").alias("bf1"), F.count("*").cast("double").alias("bf2"), F.avg("l_discount").alias("bf3"), F.avg("l_tax").alias("bf4"),
        F.max((F.col("s_acctbal") > 0).cast("int")).cast("double").alias("bf5"), F.avg("l_extendedprice").alias("tip"),
    )
    return users, items


@query(f"with {_RATINGS}, {_USER14}, j as (select r.u, r.i, rating, {', '.join(_FEATURES14)} from ratings r left join uf on r.u = uf.u left join bf on r.i = bf.i), a as (select {', '.join(f'avg({c}) m_{c}' for c in _FEATURES14)} from j) select u, i, rating, {', '.join(f'round(coalesce({c}, m_{c}), 6) {c}' for c in _FEATURES14)} from j, a")
def features14(spark: SparkSession, d: str) -> DataFrame:
    rows = recommend.features(views.ratings(spark, d), *_profiles14(spark, d))
    return _rounded(rows, ["rating", *_FEATURES14])


_BASELINE = "g as (select avg(rating) g from ratings), base as (select r.u, r.i, g + (um - g) + (im - g) baseline from ratings r join im on r.i = im.i join um on r.u = um.u, g)"


@query(f"with {_cf_sql(20)}, {_BASELINE} select b.u, b.i, round(0.95 * baseline + 0.05 * prediction, 6) prediction from base b join cf on b.u = cf.u and b.i = cf.i")
def hybrid_predictions(spark: SparkSession, d: str) -> DataFrame:
    return recommend.baseline_hybrid(_ratings(spark, d), 20).withColumn("prediction", F.round("prediction", 6))


@query(f"with {_cf_sql(20)}, {_BASELINE}, s as (select round(0.95 * baseline + 0.05 * prediction, 6) p from base b join cf on b.u = cf.u and b.i = cf.i) select cast((p >= 1)::int + (p >= 2)::int + (p >= 3)::int + (p >= 4)::int as int) bucket, count(*) n from s group by 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return recommend.histogram(hybrid_predictions(spark, d), "prediction")


@query(None)
def model_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = recommend.features(views.ratings(spark, d), *_profiles(spark, d))
    model = recommend.boosted(rows, ["review_count", "average_stars", "stars", "b_review_count"])
    return model.transform(rows).select("u", "i", "rating", "model")


@query(None)
def hybrid_model_predictions(spark: SparkSession, d: str) -> DataFrame:
    r = _ratings(spark, d)
    rows = recommend.features_once(r, *_profiles(spark, d))
    told = recommend.boosted_by_cell(rows, ["review_count", "average_stars", "stars", "b_review_count"])
    cf = settled(recommend.cf_predict(r, r, 20))
    release(spark)
    return recommend.hybrid(told(rows).select("u", "i", "model"), cf, "model")


@query(None)
def factorised_predictions(spark: SparkSession, d: str) -> DataFrame:
    r = views.ratings(spark, d)
    return recommend.factorised(r).transform(r.select("u", "i", "rating")).withColumnRenamed("prediction", "model")


_KINDS = "c as (select user_id i, avg(value) checkin_mean from events where event_type = 'view' group by 1), t as (select user_id i, count(*) tips from events where event_type = 'click' group by 1), p as (select user_id i, count(*) photos from events where event_type = 'purchase' group by 1), found as (select i, checkin_mean, tips, photos from c full join t using (i) full join p using (i))"


def _activity(spark: SparkSession, d: str) -> DataFrame:
    events = views.table(spark, d, "events").select(F.col("user_id").alias("i"), "event_type", F.col("value").alias("n"))
    return recommend.activity(*[events.where(F.col("event_type") == kind) for kind in ("view", "click", "purchase")])


@query(f"with {_KINDS} select i, round(checkin_mean, 6) checkin_mean, tips, photos from found")
def activity_features(spark: SparkSession, d: str) -> DataFrame:
    return _activity(spark, d).withColumn("checkin_mean", F.round("checkin_mean", 6))


@query(f"with {_KINDS}, m as (select avg(checkin_mean) mc, avg(tips) mt, avg(photos) mp from found) select c_custkey i, round(coalesce(checkin_mean, mc), 6) checkin_mean, round(coalesce(tips, mt), 6) tips, round(coalesce(photos, mp), 6) photos from customer left join found on c_custkey = i, m")
def activity_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    rows = recommend.with_activity(views.table(spark, d, "customer").select(F.col("c_custkey").alias("i")), _activity(spark, d))
    return rows.select("i", *[F.round(c, 6).alias(c) for c in ("checkin_mean", "tips", "photos")])


# Text profiles and encodings


@query("with t as (select l_suppkey u, l_returnflag || l_linestatus || cast(l_linenumber as varchar) \"text\", cast(l_quantity as double) stars, cast(l_linenumber as bigint) useful, cast(l_discount * 100 as bigint) funny, cast(l_tax * 100 as bigint) cool from lineitem), a as (select u, round(avg(stars), 6) stars_mean, cast(median(useful) as double) useful_median from t group by 1), lm as (select u, max_by(v, n * 1000 + v) x from (select u, length(\"text\") v, count(*) n from t group by 1, 2) group by 1), fm as (select u, max_by(v, n * 1000 + v) x from (select u, funny v, count(*) n from t group by 1, 2) group by 1), cm as (select u, max_by(v, n * 1000 + v) x from (select u, cool v, count(*) n from t group by 1, 2) group by 1) select a.u, stars_mean, useful_median, cast(lm.x as int) length_mode, fm.x funny_mode, cm.x cool_mode from a join lm using (u) join fm using (u) join cm using (u)")
def user_text_profile(spark: SparkSession, d: str) -> DataFrame:
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long")
    rows = views.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("u"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), F.col("l_quantity").alias("stars"),
        F.col("l_linenumber").cast("long").alias("useful"), hundredths("l_discount").alias("funny"), hundredths("l_tax").alias("cool"),
    )
    return recommend.text_profile(rows, "u").select("u", F.round("stars_mean", 6).alias("stars_mean"), "useful_median", "length_mode", "funny_mode", "cool_mode")


#: A small word list with scores between -1 and 1.
LEXICON = (("the", 0.2), ("of", -0.1), ("and", 0.4), ("idiot", -0.9), ("stupid", -0.8), ("der", 0.1), ("les", -0.2), ("que", 0.3), ("with", 0.6), ("was", -0.5))
_LEXICON = ", ".join(f"('{w}', {s}::double)" for w, s in LEXICON)


@query(f"with lex(word, score) as (values {_LEXICON}), w as (select doc_id, unnest(regexp_split_to_array(lower(\"text\"), '[^a-zà-ÿ]+')) word from documents), s as (select doc_id, sum(coalesce(score, 0)) / count(*) mean from w left join lex using (word) where word <> '' group by 1), a as (select d.doc_id, coalesce(mean, 0.0) mean from documents d left join s using (doc_id)) select doc_id, round(mean, 6) mean, case when mean < -0.5 then 0.5 when mean < 0 then 2.0 when mean < 0.5 then 3.0 else 4.5 end::double stars from a")
def sentiment_stars(spark: SparkSession, d: str) -> DataFrame:
    lexicon = readers.local_rows(spark, list(LEXICON), "word string, score double")
    rows = recommend.sentiment(views.table(spark, d, "documents"), "doc_id", lexicon)
    return rows.select("doc_id", F.round("mean", 6).alias("mean"), scalar.sentiment_bucket(F.col("mean")).alias("stars"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 2.0 when o_orderstatus = 'P' then 1.0 else case o_orderpriority when '1-URGENT' then 4.0 when '2-HIGH' then 3.0 when '3-MEDIUM' then 2.0 when '4-NOT SPECIFIED' then 1.0 else 3.0 end end::double noise from orders")
def noise_ordinal(spark: SparkSession, d: str) -> DataFrame:
    orders = views.table(spark, d, "orders")
    names = F.create_map(*[F.lit(x) for kv in (("1-URGENT", "quiet"), ("2-HIGH", "average"), ("3-MEDIUM", "loud"), ("4-NOT SPECIFIED", "very_loud")) for x in kv])
    attributes = F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("NoiseLevel"), F.try_element_at(names, F.col("o_orderpriority"))))
    return orders.select("o_orderkey", scalar.noise_score(attributes, F.col("o_orderstatus") != "F").alias("noise"))


@query("select user_id, round(avg(k), 6) average from (select user_id, event_type, max(cast(regexp_extract(props, '([0-9]+)', 1) as bigint)) k from events group by 1, 2) group by 1")
def map_value_mean(spark: SparkSession, d: str) -> DataFrame:
    best = views.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    maps = best.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "k"))).alias("m"))
    return maps.select("user_id", F.round(scalar.average_of_values(F.col("m")), 6).alias("average"))


# Graph

#: Distinct props values that two users have to share to be linked.
SHARED = 36
_EDGES = f"{_PAIRS}, pr as (select x.u a, y.u b from ev x join ev y on x.v = y.v and x.u < y.u group by 1, 2 having count(*) >= {SHARED}), e as (select a src, b dst from pr union all select b, a from pr)"
_WALKS = "with recursive {}, w as (select distinct src s, src v, 0 k, 1::double c from e union all select w.s, e.dst, w.k + 1, sum(w.c) from w join e on w.v = e.src where w.k < 24 group by 1, 2, 3), dd as (select s, v, min(k) d from w group by 1, 2), g as (select w.s, w.v, d, c from dd join w on w.s = dd.s and w.v = dd.v and w.k = dd.d)"


def _user_sets(spark: SparkSession, d: str) -> DataFrame:
    return views.event_pairs(spark, d).select(F.col("user").alias("item"), F.col("value").alias("element"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return settled(graph.co_occurrence_edges(_user_sets(spark, d), SHARED))


def _kinds(spark: SparkSession, d: str) -> graph.Kinds:
    return graph.co_occurrence_kinds(_user_sets(spark, d), SHARED)


@query(f"with {_EDGES} select src, dst from e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"with {_EDGES} select distinct src id from e")
def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d).of.select("id")


@query(f"{_WALKS.format(_EDGES)} select s, v, d, c::bigint sigma from g")
def shortest_path_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths_by_kind(_kinds(spark, d))


@query(f"{_WALKS.format(_EDGES)}, b as (select least(e.src, e.dst) u, greatest(e.src, e.dst) v, sum(a.c * z.c * 1.0 / st.c) / 2 x from e join g a on a.v = e.src join g z on z.s = e.dst join g st on st.s = a.s and st.v = z.v and st.d = a.d + 1 + z.d group by 1, 2) select u, v, round(x, 5) betweenness from b")
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness_by_kind(_kinds(spark, d)).select("u", "v", F.round("betweenness", 5).alias("betweenness"))


def _lpa_sql() -> str:
    steps = ["l0 as (select distinct src v, src l from e)"]
    for k in range(5):
        steps.append(f"n{k} as (select e.dst v, l, count(*) n from e join l{k} on e.src = l{k}.v group by 1, 2), l{k + 1} as (select v, l from (select v, l, row_number() over (partition by v order by n desc, l) r from n{k}) where r = 1)")
    return f"with {_EDGES}, {', '.join(steps)}"


@query(f"{_lpa_sql()} select v id, l label from l5")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation_by_kind(_kinds(spark, d))


@query(f"{_lpa_sql()} select l label, string_agg(v, '|' order by v) members, count(*) size from l5 group by 1")
def communities(spark: SparkSession, d: str) -> DataFrame:
    found = graph.communities(graph.label_propagation_by_kind(_kinds(spark, d)))
    return found.select("label", joined("members", "members"), F.size("members").cast("long").alias("size"))


@query(f"{_WALKS.format(_EDGES)} select s id, min(v) component from g group by 1")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components_by_kind(_kinds(spark, d))


@query(f"{_lpa_sql()}, x as (select p.l a, q.l b from e join l5 p on e.src = p.v join l5 q on e.dst = q.v), y as (select a, sum(case when a = b then 1 else 0 end) inside, count(*) degree from x group by 1) select round(sum(inside / (select count(*) from e) - pow(degree / (select count(*) from e), 2)), 6) modularity from y")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    g = _kinds(spark, d)
    parts = graph.label_propagation_by_kind(g).select("id", F.col("label").alias("component"))
    return graph.modularity_by_kind(g, parts).select(F.round("modularity", 6).alias("modularity"))


@query(None)
def girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    parts, value = graph.girvan_newman(_edges(spark, d))
    return parts.withColumn("modularity", F.lit(value))


# Stream sketches

BATCH, FILTER_BITS = 1000, 499
_STREAM = f"s as (select cast(user_id as varchar) u, cast(row_number() over (order by ts, event_id) - 1 as bigint) seq from events), st as (select u, seq, seq // {BATCH} batch from s)"
_HASHED = "x as (select distinct u, cast(list_reduce(list_prepend(0::bigint, list_transform(range(1, strlen(u) + 1), lambda k: ascii(substr(u, k, 1))::bigint)), lambda a, b: (a * 256 + b) % 69997) as bigint) x from st), hh as (select u, j, ((7919 * (j + 1) + 104729) * x + 1299709 * (j + 3)) % {} h from x, range(10) t(j))"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    events = views.stream(spark, d)
    rows = readers.batches(events, BATCH, F.unix_date(F.col("ts").cast("date")), ["ts", "event_id"])
    return rows.select("seq", "batch", F.col("user_id").cast("string").alias("user"))


@query(f"with {_STREAM} select batch, count(*) n, min(seq) first, max(seq) last, count(distinct u) users from st group by 1")
def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d).groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.countDistinct("user").alias("users"))


@query(f"with {_STREAM}, {_HASHED.format(sketch.BITS)} select u \"user\", cast(j as int) j, h from hh")
def polynomial_hash(spark: SparkSession, d: str) -> DataFrame:
    return sketch.hashes(_stream(spark, d).select("user").distinct(), "user", sketch.BITS)


_BLOOM = f"with {_STREAM}, {_HASHED.format(FILTER_BITS)}, f as (select u, min(seq) seq, min(batch) batch from st group by 1), fh as (select f.u, seq, batch, h from f join hh on f.u = hh.u), fs as (select h, min(seq) first from fh group by 1), told as (select u, seq, batch, bool_and(fs.first < seq) fp from fh join fs using (h) group by 1, 2, 3)"


@query(f"{_BLOOM}, t as (select batch, count(*) n, count(*) filter (where fp) k from told group by 1) select b.batch, coalesce(n, 0) new_users, coalesce(k, 0) false_positives, round(case when n > 0 then k / n else 0 end, 6) rate from (select distinct batch from st) b left join t using (batch)")
def bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    return sketch.bloom_rate(_stream(spark, d), bits=FILTER_BITS).withColumn("rate", F.round("rate", 6))


_FM = f"with {_STREAM}, {_HASHED.format(sketch.BITS)}, tz as (select u, j, case when h = 0 then 1 else bit_count((h & -h) - 1) end z from hh), rg as (select batch, j, max(z) r from (select distinct batch, u from st) b join tz using (u) group by 1, 2), tr as (select batch, count(*) length, count(distinct u) \"distinct\" from st group by 1)"


@query(f"{_FM}, es as (select batch, cast(floor(avg(1::bigint << r::int)) as bigint) estimate from rg group by 1) select batch, length, \"distinct\", estimate from tr join es using (batch)")
def flajolet_martin(spark: SparkSession, d: str) -> DataFrame:
    return sketch.flajolet_martin(_stream(spark, d))


@query(f"{_FM}, gm as (select batch, j % 5 g, avg(1::bigint << r::int) m from rg group by 1, 2), es as (select batch, cast(floor(median(m)) as bigint) estimate from gm group by 1) select batch, length, \"distinct\", estimate from tr join es using (batch)")
def fm_median_of_means(spark: SparkSession, d: str) -> DataFrame:
    return sketch.flajolet_martin(_stream(spark, d), groups=5)


_RESERVOIR = f"with {_STREAM}, dr as (select *, (seq * 48271 + 553 * 7919 + 12345) % 2147483647 draw from st), ac as (select seq, batch, u, case when seq < 100 then seq else draw * 69621 % 2147483647 % 100 end slot from dr where seq < 100 or (draw * 16807 % 2147483647) / 2147483647.0::double < 100 / (seq + 1))"


@query(f"{_RESERVOIR}, b as (select distinct batch from st), g as (select batch, slot from b, range(0, 100, 20) t(slot)), h as (select g.batch, g.slot, max_by(u, seq) \"user\" from g join ac on ac.slot = g.slot and ac.batch <= g.batch group by 1, 2) select * from h")
def reservoir(spark: SparkSession, d: str) -> DataFrame:
    return sketch.reservoir(_stream(spark, d), 100, [0, 20, 40, 60, 80])


@query(None)
def hll_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d).groupBy("batch").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user")).alias("estimate"))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))


def _start(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') start, event_type, count(*) n from events group by 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return _start(sketch.event_windows(_times(spark, d), F.col("t"), "1 hour"))


@query("with w as (select time_bucket(interval '30 minutes', ts) - k * interval '30 minutes' s, event_type from events, range(2) x(k)) select strftime(s, '%Y-%m-%d %H:%M:%S') start, event_type, count(*) n from w group by 1, 2")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _start(sketch.event_windows(_times(spark, d), F.col("t"), "1 hour", "30 minutes"))


@query("with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '2 hours' then 0 else 1 end fresh, event_id from events), b as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) k from a) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n from b group by user_id, k")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return _start(sketch.sessions(_times(spark, d), F.col("t"), "2 hours", "user_id"))


@query(_BLOOM + ' select u "user", seq, batch, fp false_positive from told')
def stream_bloom(spark: SparkSession, d: str) -> DataFrame:
    return streams.bloom(streams.replay(_stream(spark, d)), bits=FILTER_BITS)


@query(f"{_FM}, es as (select batch, cast(floor(avg(1::bigint << r::int)) as bigint) estimate from rg group by 1) select batch, length, estimate from tr join es using (batch)")
def stream_fm(spark: SparkSession, d: str) -> DataFrame:
    return streams.flajolet_martin(streams.replay(_stream(spark, d)))


@query(f"{_RESERVOIR} select cast(slot as bigint) slot, max_by(u, seq) \"user\" from ac group by 1")
def stream_reservoir(spark: SparkSession, d: str) -> DataFrame:
    return streams.reservoir(streams.replay(_stream(spark, d)), 100)


# Clustering

_POINTS = "p as (select vec_id id, label, generate_subscripts(embedding, 1) dim, unnest(embedding)::double x from embeddings)"
_SUMS = "c as (select label, dim, count(*) n, sum(x) s, sum(x * x) q from p group by 1, 2)"


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.summaries(views.points(spark, d).withColumnRenamed("label", "cluster"))


@query(f"with {_POINTS}, {_SUMS} select label cluster, cast(dim - 1 as int) dim, n, round(s, 6) s, round(q, 6) q from c")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    long = _clusters(spark, d).select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "x"))
    return long.select("cluster", "dim", "n", F.round("x.sum", 6).alias("s"), F.round("x.sumsq", 6).alias("q"))


@query(f"with {_POINTS}, {_SUMS}, g as (select id, c.label cluster, sqrt(sum(pow(x - s / n, 2) / (q / n - pow(s / n, 2)))) dist from p join c using (dim) group by 1, 2), r as (select id, cluster, dist, row_number() over (partition by id order by dist, cluster) k from g) select id, cluster, round(dist, 5) distance from r where k = 1")
def mahalanobis_assign(spark: SparkSession, d: str) -> DataFrame:
    return clustering.nearest(views.points(spark, d), _clusters(spark, d)).withColumn("distance", F.round("distance", 5))


@query(f"with {_POINTS}, {_SUMS}, w as (select x.label a, y.label b, sqrt(sum(pow(x.s / x.n - y.s / y.n, 2) / (y.q / y.n - pow(y.s / y.n, 2)))) d1, sqrt(sum(pow(x.s / x.n - y.s / y.n, 2) / (x.q / x.n - pow(x.s / x.n, 2)))) d2 from c x join c y on x.dim = y.dim and x.label < y.label group by 1, 2) select a, b, round(least(d1, d2), 5) distance from w")
def cluster_distance(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster_distance(_clusters(spark, d)).withColumn("distance", F.round("distance", 5))


@query("with o as (select vec_id id, row_number() over (order by (vec_id * 48271 + 10 * 69621 + 12345) % 2147483647, vec_id) - 1 seq from embeddings) select id, cast(least(seq // greatest(1, (select count(*) from embeddings) // 5), 4) as int) chunk from o")
def chunked_points(spark: SparkSession, d: str) -> DataFrame:
    return clustering.chunked(views.points(spark, d).select("id"), 5)


def _lloyd_sql(k: int, rounds: int) -> str:
    steps = [_POINTS, f"i0 as (select id, cast(row_number() over (order by id) - 1 as bigint) cl from (select distinct id from p) order by id limit {k}), c0 as (select cl, dim, x from p join i0 using (id))"]
    for r in range(rounds):
        steps.append(f"g{r} as (select p.id, cl, round(sum(pow(p.x - c.x, 2)), 9) gap from p join c{r} c using (dim) group by 1, 2), a{r} as (select id, cl from (select id, cl, row_number() over (partition by id order by gap, cl) k from g{r}) where k = 1), c{r + 1} as (select cl, dim, sum(x) / count(*) x from p join a{r} using (id) group by 1, 2)")
    return f"with {', '.join(steps)} select id, cl cluster from a{rounds - 1}"


@query(_lloyd_sql(10, 3))
def kmeans_fixed_init(spark: SparkSession, d: str) -> DataFrame:
    return clustering.lloyd(views.points(spark, d), 10, 3)


@query(None)
def bfr_rounds(spark: SparkSession, d: str) -> DataFrame:
    return clustering.bfr(views.points(spark, d), 10)[1]


@query(None)
def bfr_labels(spark: SparkSession, d: str) -> DataFrame:
    return clustering.bfr(views.points(spark, d), 10)[0]
