"""Small fixtures that pin how each operator treats ties, unknown keys, nulls and empty inputs."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import lineage, scalar
from quarrykit.functions.ranking import numbered
from quarrykit.operators import clustering, graph, itemsets, recommend, relational, similarity, sketch
from quarrykit.sources import readers, sinks
from quarrykit.streaming import sketches as streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.collect()[0][0]


def value(spark, column, *rows, schema="x string"):
    return [r[0] for r in frame(spark, [(x,) for x in rows], schema).select(column).collect()]


def test_scalar_functions(spark):
    assert value(spark, scalar.bytes_modulo(F.col("x"), 69997), "", "a", "abc", None) == [0, 97, int(b"abc".hex(), 16) % 69997, None]
    assert value(spark, scalar.trailing_zeros(F.col("x")), 0, 1, 8, 12, schema="x long") == [1, 0, 3, 2]
    assert value(spark, scalar.clean_number(F.col("x")), '"00012"', '"000"', "7", "x", None) == [12, 0, 7, None, None]
    assert value(spark, scalar.bucketed(F.col("x")), 0.5, 1.0, 3.99, 4.0, schema="x double") == [0, 1, 3, 4]
    assert value(spark, scalar.sentiment_bucket(F.col("x")), -0.6, -0.5, 0.0, 0.5, schema="x double") == [0.5, 2.0, 3.0, 4.5]
    maps = frame(spark, [({"a": 1, "b": 2},), ({},), (None,)], "m map<string,int>")
    assert [r[0] for r in maps.select(scalar.average_of_values(F.col("m"))).collect()] == [1.5, 0.0, 0.0]
    noise = frame(spark, [({"NoiseLevel": "quiet"}, True), ({"NoiseLevel": "odd"}, True), ({}, True), (None, True), (None, False)], "m map<string,string>, known boolean")
    assert [r[0] for r in noise.select(scalar.noise_score(F.col("m"), F.col("known"))).collect()] == [4.0, 3.0, 3.0, 1.0, 2.0]


def test_ties_at_the_top(spark):
    rows = frame(spark, [("b",), ("a",), ("b",), ("a",), ("c",)], "k string")
    assert [r.k for r in relational.tied_top(rows, "k").collect()] == ["a", "b"]
    assert [tuple(r) for r in relational.top_k(rows, "k", 3).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [r.k for r in relational.bottom_k(rows, "k", 2).collect()] == ["c", "b"]
    assert relational.tied_top(rows.limit(0), "k").count() == 0


def test_substring_is_not_the_year(spark):
    rows = frame(spark, [(1, 1, "2018-01-01"), (1, 2, "1999-12018"), (2, 1, "1999-01-01"), (2, 1, None)], "u int, i int, day string")
    assert tuple(relational.review_summary(rows, "2018").first()) == (4, 2, 2, 2)


def test_reviews_without_a_city_form_a_group(spark):
    facts = frame(spark, [(1, 4.0), (1, 2.0), (2, 5.0), (9, 1.0)], "i int, stars double")
    dim = frame(spark, [(1, "X"), (2, "Y")], "item int, city string")
    got = [tuple(r) for r in relational.average_by_dimension(facts, dim, "i", "item", "city", "stars").collect()]
    assert got == [("Y", 5.0), ("X", 3.0), (None, 1.0)]
    again = {r.city: r.average for r in relational.average_of_two_aggregates(facts, dim, "i", "item", "city", "stars").collect()}
    assert again == {"Y": 5.0, "X": 3.0, None: 1.0}


def test_custom_partitioner_places_exactly(spark):
    rows = frame(spark, [("a1",), ("b2",), ("a3",)], "k string")
    placed = relational.dealt_by(rows, 4, relational.first_character("k")).select("k", F.spark_partition_id().alias("p")).collect()
    assert {r.k: r.p for r in placed} == {"a1": 97 % 4, "a3": 97 % 4, "b2": 98 % 4}


def test_mode_takes_the_largest_of_several(spark):
    rows = frame(spark, [(1, 3), (1, 3), (1, 5), (1, 5), (2, 1)], "k int, v int")
    assert {r.k: r.m for r in relational.mode_largest(rows, "k", "v", "m").collect()} == {1: 5, 2: 1}


def test_itemsets(spark):
    rows = frame(spark, [(b, i) for b, items in enumerate(["abc", "abc", "ab", "c", "ad"]) for i in items], "b int, i string")
    want = {("a",): 4, ("b",): 3, ("c",): 3, ("a", "b"): 3, ("a", "c"): 2, ("b", "c"): 2, ("a", "b", "c"): 2}
    got = lambda df: {tuple(r["items"]): r.support for r in df.collect()}
    assert got(itemsets.frequent(rows, 2)) == want
    assert got(itemsets.son(rows, 2, 3, F.col("b"))) == want
    assert got(itemsets.fp_growth(rows, 2)) == want
    assert got(itemsets.frequent(rows, 99)) == {} == got(itemsets.son(rows, 99, 2, F.col("b")))
    assert got(itemsets.frequent(rows.limit(0), 1)) == {}
    assert set(want) <= {tuple(r["items"]) for r in itemsets.son_candidates(rows, 2, 3, F.col("b")).collect()}
    assert [tuple(r) for r in itemsets.frequent_pairs(rows, 3).collect()] == [("a", "b", 3)]
    assert [r["items"] for r in itemsets.as_sets(rows, larger_than=2).orderBy("b").collect()] == [["a", "b", "c"]] * 2


def test_itemsets_by_kind(spark):
    rng = random.Random(4)
    baskets = {i: [b for b in range(12) if rng.random() < 0.6] for i in "abcdefg"}
    baskets |= {"a2": baskets["a"], "a10": baskets["a"], "c2": baskets["c"], "h": []}
    rows = frame(spark, [(b, i) for i, own in baskets.items() for b in own], "b int, i string")
    got = lambda df: sorted((tuple(r["items"]), r.support) for r in df.collect())
    for support in (4, 99):
        want = got(itemsets.frequent(rows, support))
        assert got(itemsets.frequent_by_kind(rows, support)) == want
        assert support != 4 or max(len(x) for x, _ in want) > 4
    odd = rows.unionByName(frame(spark, [(None, "z"), (None, "a"), (1, None)], "b int, i string"))
    assert got(itemsets.frequent_by_kind(odd, 1)) == got(itemsets.frequent(odd, 1).where("items[0] is not null"))
    assert got(itemsets.frequent_by_kind(rows.limit(0), 1)) == []


def test_itemsets_within_tasks_equal_those_by_level(spark, monkeypatch):
    rng = random.Random(12)
    data = [(b, f"i{x}") for b in range(16) for x in range(30) if rng.random() < 0.55] + [(3, None), (4, None)]
    rows = frame(spark, data, "b int, i string")
    got = lambda df: sorted((tuple(r["items"]), r.support) for r in df.collect())
    want = got(itemsets.frequent_by_kind(rows, 6, whole=False))
    assert max(len(x[0]) for x in want) >= 4
    monkeypatch.setattr(itemsets, "kinds_of_members", None)  # no join of kinds
    for at_a_time, some in ((64, 1024), (2, 3)):
        monkeypatch.setattr(itemsets, "_AT_A_TIME", at_a_time)
        monkeypatch.setattr(itemsets, "_ROWS", some)
        assert got(itemsets.frequent_by_kind(rows, 6, whole=True)) == want
    assert got(itemsets.frequent_by_kind(rows.limit(0), 1, whole=True)) == []


def test_pcy_equals_plain_pairs(spark):
    rows = frame(spark, [(b, i) for b in range(40) for i in range(8) if (b * 7 + i * i) % 3], "b int, i long")
    plain = {(r.a, r.b): r.support for r in itemsets.frequent_pairs(rows, 15).collect()}
    for buckets in (1, 3, 1009):
        assert {(r.a, r.b): r.support for r in itemsets.pcy_pairs(rows, 15, buckets).collect()} == plain


def test_similar_pairs_are_exact(spark):
    rows = frame(spark, [(i, e) for i in range(30) for e in "abcdefghijklmnop" if hash((i // 3, e)) % 2 or (i % 3 == 0 and e == "a")], "item int, element string")
    exact = {(r.a, r.b, round(r.similarity, 9)) for r in similarity.exact_pairs(rows, 0.5).collect()}
    found = {(r.a, r.b, round(r.similarity, 9)) for r in similarity.similar_pairs(rows, 0.5).collect()}
    assert found <= exact
    assert {x for x in exact if x[2] == 1.0} <= found


def test_filtered_overlaps_equal_all_overlaps(spark):
    data = [(f"u{i:02d}", (i * i + 7 * e) % 41) for i in range(40) for e in range(12 + i % 9)] + [("u00", 1), ("u00", None), (None, 1), ("lone", 999)]
    rows = frame(spark, data * 2, "item string, element int")
    every = {(r.a, r.b): r.common for r in similarity.overlaps(rows).collect()}
    for need in (0, 5, 30):
        got = {(r.a, r.b): r.common for r in similarity.filtered_overlaps(rows, F.lit(need)).collect()}
        assert got == {k: n for k, n in every.items() if n >= need}
    sets = {}
    for i, e in data:
        if i is not None and e is not None:
            sets.setdefault(i, set()).add(e)
    for least in (0.3, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in similarity.exact_pairs(rows, least).collect()} == want
    assert similarity.filtered_overlaps(rows.limit(0), F.lit(2)).count() == 0


def test_sets_that_nearly_all_meet_are_compared_without_rows_of_candidates(spark, monkeypatch):
    rng = random.Random(8)
    sets = {f"u{i}": set(rng.sample(range(60), rng.randint(20, 40))) for i in range(150)}
    sets |= {f"v{i}": sets[f"u{i}"] for i in range(9)}  # copies
    rows = frame(spark, [(i, f"e{e}") for i, s in sets.items() for e in s] + [(None, "e1"), ("u1", None)], "item string, element string")
    want = {(a, b): (len(p & q), len(p), len(q)) for a, p in sets.items() for b, q in sets.items() if a < b}
    found = similarity.filtered_overlaps(rows, F.lit(18))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in similarity.filtered_overlaps(rows, F.lit(18), tiled=False)._jdf.queryExecution().executedPlan().toString()
    for tiled in (True, False):
        got = [((r.a, r.b), (r.common, r.na, r.nb)) for r in similarity.filtered_overlaps(rows, F.lit(18), tiled=tiled).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if v[0] >= 18}
        assert {(r.a, r.b) for r in similarity.exact_pairs(rows, 0.4, tiled).collect()} == {k for k, (c, m, n) in want.items() if c >= 0.4 * (m + n - c)}
    plain, tiled = ([x.collect() for x in similarity.kinds(rows, F.lit(18), t)] for t in (False, True))
    assert all(set(x) == set(y) and len(x) == len(y) for x, y in zip(plain, tiled, strict=True))

    monkeypatch.setattr(similarity, "_ROWS", 7)
    monkeypatch.setattr(similarity, "_WIDE", 11)
    names, lo = sorted(sets), pa.array([0] * 80, pa.int32())
    columns = lambda of, block, hi: pa.RecordBatch.from_arrays([pa.array(of), pa.array([18] * len(of), pa.int32()), pa.array([sorted(sets[x]) for x in of], pa.list_(pa.int32())), pa.array([block] * len(of), pa.int32()), lo.slice(0, len(of)), pa.array([hi] * len(of), pa.int32())], ["id", "need", "members", "block", "lo", "hi"])
    met = lambda *x: {(a, b): c for y in similarity._tile_met(0.0)(iter(x)) for a, b, c in zip(*(y.column(k).to_pylist() for k in ("a", "b", "common")), strict=True)}
    both = met(columns(names[80:], 1, 1), columns(names[:80], 0, 1))
    assert both == {(a, b): want[a, b][0] for a in names[:80] for b in names[80:] if want[a, b][0] >= 18}
    assert met(columns(names[:80], 0, 0)) == {(a, b): c for (a, b), (c, _, _) in want.items() if a in names[:80] and b in names[:80] and c >= 18}
    assert met(columns(names[:5], 0, 1)) == {} == met()


def test_bands_that_meet_nearly_all_are_compared_without_rows_of_candidates(spark, monkeypatch):
    rng = random.Random(8)
    data = [(i, f"e{x}") for i in range(60) for x in (range(5) if i % 20 == 0 else rng.sample(range(30), rng.randint(1, 15)))] + [(None, "e1")]
    rows = frame(spark, data, "item long, element string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    near = lambda df: [(r.a, r.b, round(r.similarity, 9)) for r in sorted(df.collect(), key=lambda r: (r.a, r.b))]
    met, pairs = plain(similarity.candidate_pairs(rows, tiled=False)), near(similarity.similar_pairs(rows, 0.2, tiled=False))
    hashed = near(similarity.mllib_pairs(rows, 0.2, 4, tiled=False))
    assert len(met) > len(pairs) > len(hashed) > 50
    monkeypatch.setattr(similarity, "_ROWS", 4)
    monkeypatch.setattr(similarity, "candidates", None)  # no join of bands
    assert plain(similarity.candidate_pairs(rows, tiled=True)) == met
    assert near(similarity.similar_pairs(rows, 0.2, tiled=True)) == pairs
    assert near(similarity.mllib_pairs(rows, 0.2, 4, tiled=True)) == hashed
    none = rows.limit(0)
    assert plain(similarity.candidate_pairs(none, tiled=True)) == [] == plain(similarity.similar_pairs(none, 0.2, tiled=True))
    for keys, joined in (([1, 1], True), (None, False)):  # 4,498,500 rows of a join or none
        some = spark.range(3000).select(F.col("id").alias("item"), F.lit(keys).alias("keys") if keys else F.array("id", "id").alias("keys"))
        assert similarity._better_compared(some, 2, some, 1e-9) == joined


def test_equal_sets_are_hashed_and_joined_once(spark, monkeypatch):
    from pyspark.ml.feature import MinHashLSHModel

    rng, joined = random.Random(4), []
    some = [rng.sample(range(30), 12) for _ in range(6)]
    sets = {i: set(some[i % 6]) for i in range(24)}  # four items of each kind
    rows = frame(spark, [(i, str(e)) for i in sets for e in sets[i]], "item long, element string")
    plain = similarity.candidates(similarity.signatures(rows))
    pairs = {(r.a, r.b) for r in plain.collect()}
    count = lambda self, x, *more, f=similarity.candidates, **kw: joined.append(x.count()) or f(x, *more, **kw)
    monkeypatch.setattr(similarity, "candidates", lambda x, *more: count(None, x, *more))
    got = [(r.a, r.b) for r in similarity.candidate_pairs(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    jaccard = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(rows, 0.2).collect()}
    assert got == pytest.approx({k: v for k, v in jaccard.items() if v >= 0.2})
    join = MinHashLSHModel.approxSimilarityJoin
    monkeypatch.setattr(MinHashLSHModel, "approxSimilarityJoin", lambda self, x, *more: joined.append(x.count()) or join(self, x, *more))
    found = [(r.a, r.b, r.similarity) for r in similarity.mllib_pairs(rows, 0.2).collect()]
    assert len(found) == len({x[:2] for x in found}) and all(s == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b, s in found)
    assert {(a, b) for a in sets for b in sets if a < b and sets[a] == sets[b]} <= {x[:2] for x in found}
    assert joined == [6, 6, 6]


def ratings(spark):
    rows = [(u, i, float(1 + (u * i + u) % 5)) for u in range(1, 9) for i in range(1, 7) if (u + i) % 4]
    return frame(spark, rows, "u long, i long, rating double")


def test_pearson_against_definition(spark):
    data = {(r.u, r.i): r.rating for r in ratings(spark).collect()}
    mean = {i: sum(v for (_, j), v in data.items() if j == i) / sum(j == i for _, j in data) for i in range(1, 7)}
    for r in recommend.pearson(ratings(spark)).collect():
        z = [(data[u, r.a] - mean[r.a], data[u, r.b] - mean[r.b]) for u in range(1, 9) if (u, r.a) in data and (u, r.b) in data]
        below = math.sqrt(sum(x * x for x, _ in z) * sum(y * y for _, y in z))
        assert r.similarity == pytest.approx(sum(x * y for x, y in z) / below if below else 0.0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_items_are_summed_where_they_are_made(spark):
    data = ratings(spark)
    assert not re.search(r"hashpartitioning\(a#|hashpartitioning\([^)]*\bb#", plan(recommend.pearson(data)))
    want = {(r.a, r.b): r.similarity for r in recommend.pearson(data, blocks=([], 1)).collect()}
    for blocks in (([2, 3, 4, 5, 6], 6), ([4], 2), ([-1, 99], 3)):
        assert {(r.a, r.b): r.similarity for r in recommend.pearson(data, blocks=blocks).collect()} == pytest.approx(want)
    some = frame(spark, [(1, 1), (1, 5), (2, 3), (None, 1), (1, None), (8, 6), (99, 2)], "u long, i long")
    every = data.select("u", "i")
    assert not re.search(r"hashpartitioning\([^)]*\bb#", plan(recommend.cf_predict(data, every, 2)))
    all_ = {(r.u, r.i): r.prediction for r in recommend.cf_predict(data, every, 2).collect()}
    own = {(r.u, r.i): r.prediction for r in recommend.cf_predict(data, data, 2).collect()}
    assert own == pytest.approx(all_) and len(own) == data.count()
    got = {(r.u, r.i): r.prediction for r in recommend.cf_predict(data, some, 2).collect()}
    assert len(got) == 7 and all(got[k] == pytest.approx(own[k]) for k in got if k in own)


def test_predictions_store_no_pairs_and_need_no_join(spark, monkeypatch):
    data, kept = ratings(spark), []
    monkeypatch.setattr(recommend, "settled", lambda df: kept.append(df.columns) or lineage.settled(df))
    for targets in (data, data.select("u", "i")):
        recommend.cf_predict(data, targets, 2).collect()
    assert kept and not any("similarity" in x or {"a", "b"} <= set(x) for x in kept)
    got = {(r.u, r.i): r for r in recommend.cf_predict(data, data, 2, more=True).collect()}
    assert {k: r.rating for k, r in got.items()} == {(r.u, r.i): r.rating for r in data.collect()}
    want = recommend.hybrid(recommend.baseline_predict(data, data), recommend.cf_predict(data, data, 2), "baseline")
    mixed = {(r.u, r.i): r.prediction for r in recommend.baseline_hybrid(data, 2).collect()}
    assert mixed == pytest.approx({(r.u, r.i): r.prediction for r in want.collect()}) and len(mixed) == data.count()
    cold = frame(spark, [(1, 99), (99, 1), (99, 99)], "u long, i long")
    assert "MapInArrow" not in plan(recommend.cf_predict(data, cold, 2))  # nothing to weigh, so no pairs


def test_users_who_rate_all_over_are_dealt_in_parts(spark, monkeypatch):
    rng, kept = random.Random(5), []
    rows = [(f"u{u}", i, float(rng.randint(1, 5))) for u in range(60) for i in rng.sample(range(40), rng.randint(1, 20))]
    data = lineage.settled(frame(spark, [*rows, (None, 3, 2.0), ("u1", None, 4.0)], "u string, i long, rating double"))
    targets = frame(spark, [("u1", i) for i in range(45)] + [("new", 2), (None, 2), ("u2", None)], "u string, i long")
    found = lambda *x: sorted((tuple(r) for r in recommend.cf_predict(data, *x).collect()), key=str)
    want = found(data, 5, True), found(targets, 5)
    assert sum(m is not None and abs(p - m) > 1e-9 for _, _, p, _, m, _ in want[0]) > 100  # most are weighed
    monkeypatch.setattr(recommend, "settled", lambda df: kept.append(df.columns) or lineage.settled(df))
    for held, copies in ((40, 4), (400, 3)):
        kept.clear()
        monkeypatch.setattr(recommend, "_HELD", held)
        monkeypatch.setattr(recommend, "_COPIES", copies)
        for got, rows in ((found(data, 5, True), want[0]), (found(targets, 5), want[1])):
            assert [r[:2] for r in got] == [r[:2] for r in rows]
            assert [x for r in got for x in r[2:]] == pytest.approx([x for r in rows for x in r[2:]])
        assert sum(x == ["u", "i", "prediction", "rating", "item_mean", "user_mean"] for x in kept) > 1


@pytest.mark.parametrize("piece", [1, 9, 1 << 18])
def test_a_range_of_items_against_plain_sums(monkeypatch, piece):
    monkeypatch.setattr(recommend, "_PIECE", piece)
    rng = random.Random(3)
    data = {(u, i): float(rng.randint(1, 5)) for u in range(40) for i in rng.sample(range(60), rng.randint(1, 9))}
    mean = {i: sum(v for (_, j), v in data.items() if j == i) / sum(j == i for _, j in data) for i in {i for _, i in data}}
    of = {u: sorted(i for v, i in data if v == u) for u in range(40)}

    def want(u, a):
        up = down = 0.0
        for b in of[u]:
            z = [(data[v, a] - mean[a], data[v, b] - mean[b]) for v in range(40) if (v, a) in data and (v, b) in data]
            below = math.sqrt(sum(x * x for x, _ in z) * sum(y * y for _, y in z))
            s = sum(x * y for x, y in z) / below if below and a != b else 0.0
            up, down = up + max(s, 0) * data[u, b], down + max(s, 0)
        return up / down if up * down else mean[a]

    rows = []
    for u, items in of.items():  # the range of items 20 to 39; users that are divisible by 3 don't ask, two ask for what they have not rated
        extra = [i for i in range(20, 40) if i in mean and i not in items][:2] if u % 3 else []
        own = [i for i in items if 20 <= i < 40]
        if own or extra:
            k = sum(i < 20 for i in items) if own else -1
            rows.append({"u": u, "user_mean": 1.0, "asks": u % 3 > 0, "i": items, "r": [data[u, i] for i in items], "m": [mean[i] for i in items], "g": [True] * len(items), "ti": extra, "tm": [mean[i] for i in extra], "k": k, "own": len(own)})
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    got = pa.Table.from_batches(recommend._ranges_predicted(iter(batches))).to_pylist()
    asked = {(r["u"], i) for r in rows if r["asks"] for i in [*r["i"][max(r["k"], 0) :][: r["own"]], *r["ti"]]}
    assert {(r["u"], r["i"]) for r in got} == asked and len(got) == len(asked)
    for r in got:
        assert r["prediction"] == pytest.approx(want(r["u"], r["i"])) and r["rating"] == data.get((r["u"], r["i"]))


def test_prediction_fallbacks(spark):
    data = ratings(spark)
    item_mean = {r.i: r.average for r in recommend.averages(data, "i").collect()}
    user_mean = {r.u: r.average for r in recommend.averages(data, "u").collect()}
    targets = frame(spark, [(1, 1), (1, 99), (99, 1), (99, 99), (1, 1)], "u long, i long")
    got = {(r.u, r.i): r.prediction for r in recommend.cf_predict(data, targets, 60).collect()}
    assert got == {(1, 1): pytest.approx(item_mean[1]), (1, 99): pytest.approx(user_mean[1]), (99, 1): pytest.approx(item_mean[1]), (99, 99): 0.0}
    near = {(r.a, r.b): r.similarity for r in recommend.pearson(data, both_ways=True).collect() if r.similarity > 0}
    own = {r.i: r.rating for r in data.collect() if r.u == 1}
    down = sum(near.get((1, j), 0) for j in own if j != 1)
    want = sum(near.get((1, j), 0) * v for j, v in own.items() if j != 1) / down if down else item_mean[1]
    assert {(r.u, r.i): r.prediction for r in recommend.cf_predict(data, targets, 0).collect()}[1, 1] == pytest.approx(want)
    ladder = {(r.u, r.i): r for r in recommend.with_fallbacks(data, targets).collect()}
    assert ladder[1, 99].item_first == pytest.approx(user_mean[1]) and ladder[99, 1].user_first == pytest.approx(item_mean[1])
    assert ladder[99, 99].item_first == ladder[99, 99].user_first == pytest.approx(one(recommend.global_average(data)))


def test_unknown_profiles_are_imputed(spark):
    data = frame(spark, [(1, 1, 5.0), (2, 2, 3.0)], "u long, i long, rating double")
    users, items = frame(spark, [(1, 10.0)], "u long, a double"), frame(spark, [(1, 4.0), (2, 2.0)], "i long, b double")
    assert {(r.u, r.a, r.b) for r in recommend.features(data, users, items).collect()} == {(1, 10.0, 4.0), (2, 10.0, 2.0)}


def test_boosted_by_cell_learns_as_by_row(spark):
    rng = random.Random(3)
    rows = [(u, i, float(1 + (u % 5 + i // 7) % 5)) for u in range(40) for i in range(30) if rng.random() < 0.7]
    users, items = frame(spark, [(u, float(u % 5)) for u in range(39)], "u long, a double"), frame(spark, [(i, float(i // 7)) for i in range(30)], "i long, b double")
    data = frame(spark, rows, "u long, i long, rating double")
    key = lambda df: sorted(tuple(r) for r in df.select("u", "i", "rating", "a", "b").collect())
    train = recommend.features_once(data, users, items)
    assert key(train) == key(recommend.features(data, users, items))
    own = {(r.u, r.i): r.model for r in recommend.boosted_by_cell(train, ["a", "b"], subsample=1.0, columns_share="all")(train).collect()}
    plain = {(r.u, r.i): r.model for r in recommend.boosted(train, ["a", "b"], subsample=1.0, columns_share="all").transform(train).collect()}
    assert len(own) == len(rows) and own == pytest.approx(plain, abs=1e-6)


def test_graphs_by_kind_equal_those_by_edge(spark):
    shapes = ["abc", "abd", "abd", "bcd", "xyz", "xyz", "xyz", "cde", "de", "d", "d", "def", "efg", "efg", "mno", "aef"]
    sets = frame(spark, [(f"n{i:02d}", e) for i, s in enumerate(shapes) for e in s], "item string, element string")
    e, g = graph.settled(graph.co_occurrence_edges(sets, 2)), graph.co_occurrence_kinds(sets, 2)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert e.count() == sum(i != j and len(set(a) & set(b)) >= 2 for i, a in enumerate(shapes) for j, b in enumerate(shapes))
    assert g.size.count() < g.of.count() and rows(g.of.select("id")) == rows(graph.vertices(e))
    assert rows(graph.shortest_paths_by_kind(g)) == rows(graph.shortest_paths(e).select("s", "v", "d", "sigma"))
    assert rows(graph.edge_betweenness_by_kind(g)) == rows(graph.edge_betweenness(e))
    assert rows(graph.connected_components_by_kind(g)) == rows(graph.connected_components(e))
    assert rows(graph.label_propagation_by_kind(g, 2)) == rows(graph.label_propagation(e, 2))
    parts = graph.label_propagation(e, 2).withColumnRenamed("label", "component")
    assert one(graph.modularity_by_kind(g, parts)) == pytest.approx(one(graph.modularity(e, parts)))


def test_paths_within_tasks_equal_those_by_joins(spark, monkeypatch):
    rng = random.Random(8)
    shapes = [rng.sample("abcdefghijkl", 4) for _ in range(30)]
    shapes += [shapes[0], shapes[0], shapes[5], "yz", "yz", "xw"]
    sets = frame(spark, [(f"n{i:02d}", e) for i, s in enumerate(shapes) for e in s], "item string, element string")
    g = graph.co_occurrence_kinds(sets, 2)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    paths, found = rows(graph.shortest_paths_by_kind(g, whole=False)), rows(graph.edge_betweenness_by_kind(g, whole=False))
    assert max(d for _, _, d, _ in paths) > 2 and max(n for *_, n in paths) > 2
    monkeypatch.setattr(graph, "_CELLS", 1 << 10)
    assert rows(graph.shortest_paths_by_kind(g, whole=True)) == paths
    assert rows(graph.edge_betweenness_by_kind(g, whole=True)) == found
    none = graph.co_occurrence_kinds(sets.limit(0), 2)
    assert rows(graph.shortest_paths_by_kind(none, whole=True)) == [] == rows(graph.edge_betweenness_by_kind(none, whole=True))


def edges(spark, pairs):
    return frame(spark, [x for a, b in pairs for x in ((a, b), (b, a))], "src string, dst string")


def test_betweenness(spark):
    path = {(r.u, r.v): r.betweenness for r in graph.edge_betweenness(edges(spark, ["ab", "bc", "cd"])).collect()}
    assert path == {("a", "b"): 3.0, ("b", "c"): 4.0, ("c", "d"): 3.0}
    cycle = {(r.u, r.v): r.betweenness for r in graph.edge_betweenness(edges(spark, ["ab", "bc", "cd", "ad"])).collect()}
    assert set(cycle.values()) == {2.0} and len(cycle) == 4
    g = edges(spark, ["ab", "bc", "ac", "cd", "de", "ef", "df"])
    paths = graph.shortest_paths(g)
    total = one(graph.edge_betweenness(g, paths).agg(F.sum("betweenness")))
    assert total == pytest.approx(one(paths.agg(F.sum("d"))) / 2)
    assert graph.edge_betweenness(edges(spark, []).limit(0)).count() == 0


def test_communities(spark):
    g = edges(spark, ["ab", "bc", "ac", "cd", "de", "ef", "df"])
    parts, value = graph.girvan_newman(g)
    assert {tuple(r.members) for r in graph.communities(parts.withColumnRenamed("component", "label")).collect()} == {("a", "b", "c"), ("d", "e", "f")}
    assert value == pytest.approx(6 / 14 + 6 / 14 - 0.5)
    assert {r.component for r in graph.connected_components(edges(spark, ["ab", "cd", "bd", "ef"])).collect()} == {"a", "e"}
    assert graph.co_occurrence_edges(frame(spark, [(1, "x"), (2, "x"), (1, "y"), (2, "y"), (3, "x")], "item int, element string"), 2).count() == 2


def brute_girvan_newman(pairs):
    """The modularity and the parts after each round, by counting shortest paths from every node."""
    nodes, left, out = sorted(set("".join(pairs))), set(pairs), []
    while True:
        near = {v: [w for w in nodes if v + w in left or w + v in left] for v in nodes}
        used, part = dict.fromkeys(left, 0.0), {}
        for s in nodes:
            paths = {s: [[s]]}
            level = [s]
            while level:
                found = {}
                for v in level:
                    for w in near[v]:
                        if w not in paths:
                            found.setdefault(w, []).extend([*p, w] for p in paths[v])
                paths.update(found)
                level = list(found)
            for t, ways in paths.items():
                for p in ways:
                    for a, b in zip(p, p[1:]):
                        used[min(a + b, b + a)] += 0.5 / len(ways)
            part[s] = min(paths)
        inside = sum(part[a] == part[b] for a, b in pairs) / len(pairs)
        degree = [sum(part[v] == c for e in pairs for v in e) / 2 / len(pairs) for c in set(part.values())]
        out.append((inside - sum(x * x for x in degree), part))
        if not left:
            return out
        worst = max(round(x, 8) for x in used.values())
        left = {e for e in left if round(used[e], 8) < worst}


def test_girvan_newman_goes_on_to_the_last_edge(spark):
    pairs = "ad af ah ai be bf bi cf cg ch ci df dg ef eg eh fi gh gi".split()
    rounds = brute_girvan_newman(pairs)
    top = max(range(len(rounds)), key=lambda i: rounds[i][0])
    assert top == 11
    parts, found = graph.girvan_newman(edges(spark, pairs))
    assert found == pytest.approx(rounds[top][0]) and {r.id: r.component for r in parts.collect()} == rounds[top][1]
    graph.girvan_newman(edges(spark, ["ab", "aa"]))  # a loop at a node never goes, yet the rounds end


def test_girvan_newman_stores_no_table_for_each_round(spark, monkeypatch):
    rng = random.Random(10)
    pairs = sorted({a + b for part in ("abcdefg", "ghijk", "lmnopqr", "qrstu", "vw") for a in part for b in part if a < b and rng.random() < 0.6})
    rounds = brute_girvan_newman(pairs)
    top = max(range(len(rounds)), key=lambda i: round(rounds[i][0], 9))
    assert len(rounds) == 16 and top == 4
    stored = []
    monkeypatch.setattr(graph, "settled", lambda df: stored.append(1) or lineage.settled(df))
    parts, found = graph.girvan_newman(edges(spark, pairs))
    assert found == pytest.approx(rounds[top][0]) and {r.id: r.component for r in parts.collect()} == rounds[top][1]
    assert len(stored) < 15
    parts, found = graph.girvan_newman(edges(spark, pairs), 2)
    top = max(range(3), key=lambda i: round(rounds[i][0], 9))
    assert found == pytest.approx(rounds[top][0]) and {r.id: r.component for r in parts.collect()} == rounds[top][1]


def test_betweenness_within_a_part_equals_that_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    pairs = sorted({a + b for a in "abcdefghijklmn" for b in "abcdefghijklmn" if a < b and rng.random() < 0.3} | {a + b for a, b in zip("abcdefghijklm", "bcdefghijklmn")})
    want = {(r.u, r.v): round(r.betweenness, 8) for r in graph.edge_betweenness(edges(spark, pairs)).collect()}
    ends = [("abcdefghijklmn".index(x), "abcdefghijklmn".index(y)) for a, b in pairs for x, y in ((a, b), (b, a))]
    src, dst = (np.array(x) for x in zip(*ends))
    for cells in (graph._CELLS, 300, 40):  # by products, in blocks of sources, link by link
        monkeypatch.setattr(graph, "_CELLS", cells)
        p = graph._Part(np.arange(14), src, dst, np.ones(len(src)))
        assert {("abcdefghijklmn"[u], "abcdefghijklmn"[v]): x for u, v, x in zip(p.src, p.dst, p.used) if u < v} == pytest.approx(want)


def stream(spark, users, size=4):
    rows = frame(spark, [(i, u) for i, u in enumerate(users)], "event_id long, user string")
    return readers.batches(rows, size, F.expr("event_id div 3"), ["event_id"]).select("seq", "batch", "user")


def test_stream_sketches(spark):
    s = stream(spark, ["u%d" % (i * i % 17) for i in range(40)])
    told = {r.user: r.false_positive for r in sketch.bloom(s, bits=23).collect()}
    bits, want = set(), {}
    for i in range(40):
        u = "u%d" % (i * i % 17)
        h = [(a * (int(u.encode().hex(), 16) % sketch.BITS) + b) % 23 for a, b in map(sketch.parameters, range(10))]
        want.setdefault(u, all(x in bits for x in h))
        bits.update(h)
    assert told == want
    assert {r.user: r.false_positive for r in streams.bloom(streams.replay(s), bits=23).collect()} == want
    batch = {r.batch: (r.length, r.estimate) for r in sketch.flajolet_martin(s).collect()}
    assert {r.batch: (r.length, r.estimate) for r in streams.flajolet_martin(streams.replay(s)).collect()} == batch
    last = {r.slot: r.user for r in sketch.reservoir(s, 5).where("batch = 9").collect()}
    assert len(last) == 5 and last == {r.slot: r.user for r in streams.reservoir(streams.replay(s), 5).collect()}
    few = sketch.reservoir(stream(spark, ["a", "b"]), 5).collect()
    assert {(r.slot, r.user) for r in few} == {(0, "a"), (1, "b")}


def test_line_stream_hands_out_batches(spark, tmp_path):
    path = tmp_path / "users.txt"
    path.write_text("".join(f"u{i % 3}\n" for i in range(10)))
    counted = streams.finished(streams.count_by(streams.asked(spark, str(path), 4), "user"))
    assert {r.user: r.n for r in counted.collect()} == {"u0": 4, "u1": 3, "u2": 3}


def test_event_time_windows_as_a_stream(spark, tmp_path):
    rows = frame(spark, [(f"2024-01-01 0{i // 6}:{i % 6}0:00", "x", i) for i in range(18)], "ts string, event_type string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    whole = {(str(r.start), r.n) for r in sketch.event_windows(rows, F.col("ts"), "1 hour").collect()}
    live = streams.finished(streams.windowed_counts(streams.replay(rows, 2), "ts", "1 hour", "1 day", "event_type"))
    assert {(str(r.start), r.n) for r in live.collect()} == whole


def test_numbering_needs_no_single_task(spark):
    rows = frame(spark, [(i * 37 % 101,) for i in range(101)], "x int")
    assert [r.seq for r in numbered(rows, F.expr("x div 10"), ["x"]).orderBy("x").collect()] == list(range(101))


def test_summaries_and_distance(spark):
    pts = frame(spark, [(1, [1.0, 5.0], 0), (2, [3.0, 5.0], 0), (3, [10.0, 0.0], 1), (4, [12.0, 2.0], 1)], "id int, features array<double>, cluster int")
    s = {r.cluster: (r.n, r["sum"], r.sumsq) for r in clustering.summaries(pts).collect()}
    assert s == {0: (2, [4.0, 10.0], [10.0, 50.0]), 1: (2, [22.0, 2.0], [244.0, 4.0])}
    near = {r.id: (r.cluster, r.distance) for r in clustering.nearest(pts, clustering.summaries(pts)).collect()}
    assert near[1] == (0, 1.0) and near[3] == (1, pytest.approx(math.sqrt(2)))  # no spread in a dimension: only its mean is near
    assert clustering.bfr(pts.select("id", "features").limit(0), 3)[0].count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('user,item\n"u,1",7\nuser,item\nu2,8\n')
    assert {tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "a.csv"), "user string, item string").collect()} == {("u,1", "7"), ("u2", "8")}
    (tmp_path / "a.json").write_text('{"u": "x", "a": {"NoiseLevel": "loud"}}\n{"u": "y"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.json"), "u string, a map<string,string>").collect()
    assert [r.a and r.a["NoiseLevel"] for r in rows] == ["loud", None]
    (tmp_path / "bad.json").write_text('{"u": \n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "bad.json"), "u string").collect()
    (tmp_path / "p.txt").write_text("1,0,0.5,2\n2,1,1,3 \n")
    assert [(r.id, r.label, r.features) for r in readers.points(spark, str(tmp_path / "p.txt")).collect()] == [("1", "0", [0.5, 2.0]), ("2", "1", [1.0, 3.0])]


def written(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_reports(spark, tmp_path):
    sets = frame(spark, [(["a"],), (["b"],), (["a", "b"],)], "items array<string>")
    sinks.itemset_report(sets, sets.limit(0), str(tmp_path / "i"))
    assert written(tmp_path / "i") == "Candidates: \n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets: \n"
    sinks.community_report(frame(spark, [(["c", "d"],), (["a"],), (["a", "z"],)], "members array<string>"), str(tmp_path / "c"))
    assert written(tmp_path / "c") == "'a'\n'a', 'z'\n'c', 'd'\n"
    sinks.betweenness_report(frame(spark, [("a", "b", 1.0), ("a", "c", 2.5)], "u string, v string, betweenness double"), str(tmp_path / "b"))
    assert written(tmp_path / "b") == "('a', 'c'),2.5\n('a', 'b'),1.0\n"
    sinks.csv_report(frame(spark, [("u", "i", 1.5)], "a string, b string, c double"), str(tmp_path / "k"), ["user_id", " business_id", " prediction"])
    assert written(tmp_path / "k").splitlines()[0].replace('"', "") == "user_id, business_id, prediction"
    sinks.json_object(frame(spark, [(1, 2)], "n int, m int"), str(tmp_path / "j"))
    assert written(tmp_path / "j") == '{"n":1,"m":2}\n'
    rounds, labels = frame(spark, [(1, 5, 1, 2, 3)], "round int, n_ds long, n_ccs long, n_cs long, n_rs long"), frame(spark, [(2, -1), (1, 0)], "id int, cluster int")
    sinks.cluster_report(rounds, labels, str(tmp_path / "r"))
    assert written(tmp_path / "r") == "Round 1: 5,1,2,3\n1,0\n2,-1\n"
