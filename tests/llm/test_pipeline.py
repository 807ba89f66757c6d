"""The pipeline: its stages keep and drop what they say, on planted cases and odd rows."""

import random

import corpus_pipeline
from quarrykit.llm.common import stored
from quarrykit.llm.mixing import mixed
from tests.llm.test_operators import SCHEMA, edited, odd, prose


def planted(spark, folder):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        text = prose(rng.randint(30, 120), rng)
        if i % 5 == 0:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grobblix", "snarfulent"]))
            text = " ".join(w)
        rows.append([i, text])
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 7, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    copies = [(300 + k, clean[k][1]) for k in range(6)] + [(310 + k, edited(clean[20 + k][1], 0.01, rng)) for k in range(6)]
    item = "which of the seven rivers that cross the northern plain reaches the open sea last and why does it take so long"
    leaky = [(320 + k, prose(30, rng) + " " + item + " " + prose(20, rng)) for k in range(3)]
    every = rows + copies + leaky
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in every], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    toxic = {i for i, _ in rows if i % 5 == 0}
    return docs, toxic, {i for i, _ in copies[:6]}, {i for i, _ in leaky}, {i for i, _ in clean}


def test_stages_catch_what_is_planted(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, toxic, copies, leaky, clean = planted(spark, folder)
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stored(stage(spark, rows, folder))
        assert rows.columns == docs.columns, name
        now = {r.doc_id for r in rows.select("doc_id").collect()}
        gone, left = left - now, now
        if name == "toxicity":
            assert gone == toxic
        elif name == "near_duplicates":
            assert copies <= gone and not gone & clean and not gone & leaky
        elif name == "decontamination":
            assert gone == leaky
        else:
            assert not gone
    assert clean <= left
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == left and {r["shard"] for r in out} == set(range(corpus_pipeline.SHARDS))


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows, n in ((odd(spark), 7), (odd(spark).limit(0), 0)):  # one of two equal rows goes
        columns = rows.columns
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, folder))
            if name != "sharding":
                assert rows.columns == columns
        assert rows.count() == n


def test_mixing_stage_sorts_by_place(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x", "en", f"s{i % 3}", 1) for i in range(300)], SCHEMA)
    mixed = [r.doc_id for r in corpus_pipeline.in_mixed_order(spark, docs, "").collect()]
    assert sorted(mixed) == list(range(300)) and mixed != list(range(300))


def test_mixture_decides_the_shards(spark):
    docs = spark.createDataFrame([(i, "x%d" % i, "en", f"s{i % 3 % 2}", 1) for i in range(900)], SCHEMA)
    place = {r.doc_id: r.position for r in mixed(docs).collect()}
    rows = stored(corpus_pipeline.in_mixed_order(spark, docs, ""))
    got = corpus_pipeline.into_shards(spark, rows, "").orderBy("position").collect()
    assert len(got) == 900
    for source in ("s0", "s1"):
        in_turn = [place[r.doc_id] for r in got if r.source == source]
        assert in_turn == sorted(in_turn)


def test_mixing_stage_keeps_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(i % 50, "x%d" % (i % 75), "en", f"s{i % 4}", i % 2) for i in range(300)] + [(None, "y", "en", "s0", 1)] * 2, SCHEMA)
    mixed_rows = corpus_pipeline.in_mixed_order(spark, docs, "").collect()
    assert sorted(map(str, mixed_rows)) == sorted(map(str, docs.collect()))


def test_near_duplicate_stage_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(2)
    one, two = prose(40, rng), prose(40, rng)
    rows = [(5, one), (5, two), (6, one), (6, prose(30, rng)), (7, ""), (7, None), (7, ""), (5, two), (None, one), (8, " \t ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.without_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("5", one), ("5", two), ("6", rows[3][1]), ("7", ""), ("7", "None"), ("7", ""), ("None", one), ("8", " \t ")])
