"""Each operator against a brute-force version on small fixtures, and its defined results for odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import fingerprints, html_text, kneser_ney, language, mixing, near_dups, registry, sharding, toxicity, warc
from quarrykit.llm.common import with_rank
from quarrykit.llm.components import components
from quarrykit.llm.decontaminate import leaks
from quarrykit.llm.textcore import buffers, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstuvw") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, ids=None, sources=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, an id without text and a text without id."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "x " * 200_000, "en", None, None), (5, "Hello there", "en", "a", 11), (5, "Hello there", "en", "a", 11), (None, "no id here at all", "en", "b", 5), (7, "\U0001f600 éè \x00\x01", "en", "b", 4)]
    extra = ["component_id", "kept", "score", "position", "shard", "h", "n", "rep", "key", "item", "label"]
    return spark.createDataFrame([(*r, *["clash"] * len(extra)) for r in rows], SCHEMA + "".join(f", {c} string" for c in extra))


# Words, ranks, components


def test_words_are_cut_as_defined():
    texts = ["a  B\tc", "", None, "\x1fx\x00y", "é É\n", "z" * 5_000_000 + " end"]
    import pyarrow as pa

    raw, at = buffers(pa.array(texts))
    hashes, starts = words(raw, at)
    want = [len(tokens(t)) for t in texts]
    assert np.diff(starts).tolist() == want
    again, _ = words(*buffers(pa.array(["A b C"])))
    assert hashes[:3].tolist() == again.tolist()


def test_ranks_over_buckets(spark):
    rows = spark.createDataFrame([(g, x) for g in ("a", None, "b") for x in range(50)], "g string, x int")
    ranked = with_rank(rows, ["g"], F.expr("x div 7"), ["x"], "r").collect()
    assert all(r.r == r.x and r.r_of == 50 for r in ranked) and len(ranked) == 150


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6: near duplicates


def near_groups(texts, size, percent=80):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def edited(text, share, rng):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    base = [prose(80, rng) for _ in range(6)]
    texts = [edited(b, s, rng) for b in base for s in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08)] + ["", None, "a b", "a b", "A  B", "a"] + [prose(60, rng) for _ in range(10)]
    n, group = near_groups(texts, size)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs(spark, texts), shingle=size).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == group
    assert all(got[i].kept == (group[i] == i) for i in range(len(texts)))


@pytest.mark.parametrize(("fragment", "errors"), [(4, near_dups.ERRORS), (7, None), (near_dups.FRAGMENT, near_dups.ERRORS)])
def test_near_duplicates_in_one_crowded_bucket(spark, fragment, errors):
    """Whether or not a bucket is cut into fragments, and with or without estimates, the result is the same."""
    rng = random.Random(3)
    base = prose(60, rng)
    texts = [edited(base, s, rng) for s in (0, 0.02, 0.03, 0.05, 0.05, 0.06, 0.07, 0.08, 0.1, 0.1, 0.12, 0.15) * 4]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs(spark, texts), shingle=4, fragment=fragment, errors=errors).collect()}
    assert [got[i] for i in range(len(texts))] == near_groups(texts, 4)[1]


def test_near_duplicates_judge_rows_that_repeat_an_id_by_their_text(spark):
    rng = random.Random(4)
    one, two = prose(50, rng), prose(50, rng)
    got = near_dups.near_duplicates(docs(spark, [one, two, one + " more", two], [5, 5, 6, 7])).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [5, 5, 5, 5] and [r.kept for r in got] == [True, True, False, False]
    groups = Counter(r.group_id for r in got)
    assert sorted(groups.values()) == [2, 2]


def test_fragments_of_a_sorted_stream():
    import pyarrow as pa

    key = np.sort(np.array([1, 2, 2, 3] + [4] * 1500 + [5, 5, 6]))
    node = np.arange(len(key))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])
    for step in (1, 3, 400, 5000):
        got = pa.Table.from_batches(list(near_dups._fragments(4)(rows.slice(i, step) for i in range(0, len(key), step)))).to_pydict()
        kept = dict(zip(got["node"], zip(got["key"], got["frag"], got["cut"], strict=True), strict=True))
        assert set(kept) == {0, 1, 2, *range(4, 1507)}  # of single texts only those at the edges stay
        assert max(Counter(got["frag"]).values()) <= 4 and all(kept[v][0] == key[v] for v in kept)
        assert not kept[1][2] and kept[0][2] and kept[1506][2] and all(kept[v][2] for v in range(4, 1504))


def test_near_duplicates_of_odd_rows(spark):
    got = near_dups.near_duplicates(odd(spark)).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == 8 and by[1] == (0, 1, True) and by[3] == (0, 3, True) and by[5] == (1, 5, True) and by[4][0] == 1 and by[None] == (1, None, True)
    assert near_dups.near_duplicates(odd(spark).limit(0)).count() == 0


def test_circulant_signatures_estimate_jaccard():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    s = near_dups.circulant_signatures([near_dups.mix64(a), near_dups.mix64(b)], 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


# 1: decontamination


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks_and_reparameterised_questions(spark):
    item = "Yesterday in town Anna bought 12 kg of apples and 3 pears, later Anna sold 12 of them to Bert, how many are left"
    other = "a train leaves the station at noon and travels east for five hours before it stops again"
    renamed = item.replace("Anna", "Zoe").replace("Bert", "Max").replace("12", "77").replace("kg", "miles")
    uneven = item.replace("later Anna", "later Paula").replace("sold 12", "sold 9").replace("to Bert", "to Paula")
    texts = [prose(30) + " " + item + ". " + prose(30), prose(20) + "\n" + renamed + "\n" + prose(9), prose(100), "So: " + other.upper() + "!", None, "", " ".join(other.split()[:7]), uneven]
    got = {(r.doc_id, r.item_id): r for r in leaks(docs(spark, texts), bench(spark, [item, other, None, "", "7 8 9"])).collect()}
    assert {k for k in got if k != (7, 0)} == {(0, 0), (1, 0), (3, 1)}
    assert got[1, 0].agreement == 1.0 and got[1, 0].slots > 0 and got[0, 0].coverage > 0.9
    strict = {(r.doc_id, r.item_id) for r in leaks(docs(spark, texts), bench(spark, [item]), agreement=1.0).collect()}
    assert strict == {(0, 0), (1, 0)}  # values that change within the text disagree


def test_leaks_of_each_occurrence(spark):
    item = "A farmer sells 12 apples and buys 34 pears, then gives 12 apples to a neighbour who holds 34 pears and 56 plums in total"
    other = item.replace("12", "7").replace("34", "81").replace("56", "90")
    slip = other.replace("gives 7", "slowly gives 7")
    mixed_up = item.replace("gives 12", "gives 5").replace("holds 34", "holds 6")
    long = prose(300) + " " + item + " " + " ".join(f"{prose(30)} who holds {k} pears and {k + 3} plums in total {prose(9)} sells {k} apples and buys {k + 1} pears" for k in range(60, 75))
    texts = [f"{item} {prose(20)} {other}", f"{other} {prose(20)} {slip}", f"{item} {other}", long, mixed_up, prose(80)]
    got = {r.doc_id for r in leaks(docs(spark, texts), bench(spark, [item])).collect()}
    assert got == {0, 1, 2, 3}
    # Rows that repeat an id don't mix their values.
    assert leaks(docs(spark, [item, prose(3) + " " + other], ids=[9, 9]), bench(spark, [item])).count() == 1


def test_leaks_of_names_short_items_and_values(spark):
    people = "Anna has 3 apples. Bert has 5 pears. Carla Maria gives 3 apples to Bert and keeps the basket."
    items = [people, "capital city of France", "12 + 7 = 19", "What is the value of 3 + 4 * 2 - 1?", "Convert 5 km 300 m to 2 miles", "the value"]
    texts = [
        "so. " + people.replace("Anna", "Zoe").replace("Bert", "Jean Paul").replace("Carla Maria", "Max").replace("3", "8") + " Well.",  # 0: other names everywhere
        prose(20) + " the capital city of Spain " + prose(20), prose(20) + " capital city of France, " + prose(3),  # 1, 2: a short item, with another name and its own
        "100 200 300 " + prose(10), prose(9) + " 12 + 7 = 19 " + prose(9),  # 3, 4: numbers alone
        "What is the value of 7 " + prose(20), prose(20) + " what is the value of 3 + 4 * 2 - 1 " + prose(4),  # 5, 6
        prose(5) + " Convert 5 km 300 m to 2 miles", people.replace("3 ", "5 ").replace("Anna", "Bert").replace("Carla Maria", "Bert"),  # 7, 8: all names are one
        "the value " + prose(20),
    ]
    got = {(r.doc_id, r.item_id) for r in leaks(docs(spark, texts), bench(spark, items)).collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (4, 2), (6, 3), (7, 4)}


def plain_leaks(spark, texts, items, size=5, literals=3, coverage=0.5):
    """Pairs that hold enough windows, by Python sets over the operator's own tokens; slots are not looked at."""
    from quarrykit.llm.decontaminate import tokens as cut

    def windows(t, n):
        out = []
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            out.append(tuple(x if x >= "\x05" else x[0] for x in w) if sum(x >= "\x05" for x in w) >= literals else tuple(w))
        return set(out)

    rows = spark.createDataFrame(list(enumerate([*texts, *items])), "i long, text string").select("i", cut(F.col("text")).alias("t")).collect()
    t = [r.t for r in sorted(rows, key=lambda r: r.i)]
    found = set()
    for d in range(len(texts)):
        for k, item in enumerate(t[len(texts) :]):
            n = min(size, len(item))
            if n >= literals:
                of = windows(item, n)
                if len(of & windows(t[d], n)) >= coverage * len(of):
                    found.add((d, k))
    return found


def test_leaks_equal_brute_force_over_windows(spark):
    rng = random.Random(31)
    items = [" ".join(rng.choice([*WORDS[:60], "Anna", "Rome", "12", "7 kg"]) for _ in range(rng.choice([3, 4, 5, 9, 20]))) for _ in range(25)]
    texts = [prose(10, rng) + " " + edited(rng.choice(items), rng.choice([0, 0.05, 0.2, 0.5]), rng) + " " + prose(10, rng) for _ in range(80)]
    got = {(r.doc_id, r.item_id) for r in leaks(docs(spark, texts), bench(spark, items), agreement=0.0).collect()}
    assert got == plain_leaks(spark, texts, items) and len(got) > 30


def test_leaks_of_odd_rows(spark):
    b = bench(spark, ["one two three four five six seven"])
    assert leaks(odd(spark), b).count() == 0 == leaks(odd(spark).limit(0), b).count() == leaks(odd(spark), b.limit(0)).count()
    twice = docs(spark, ["one two three four five six seven"] * 2, [9, 9])
    assert [(r.doc_id, r.item_id) for r in leaks(twice, b).collect()] == [(9, 0)]


# 2: WARC


def test_warc_round_trip(spark):
    rows = [(3, "http://x/a b", "<p>é</p>"), (1, "http://x/1", "<p>é</p>"), (2, None, None), (4, "http://x/4", ""), (5, "http://x/5", "y" * 300_000), (None, "http://x/6", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for page, _, html in rows:
        assert (got[page].payload_bytes, got[page].payload_digest) == (len((html or "").encode()), sha(html))
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None), None: ("response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder, n = warc.write_pages(pages, least=10)
    assert n == 6 and warc.read_warc(spark, folder, ["warc_type"]).where("warc_type = 'revisit'").count() == 0


def test_warc_reader_skips_and_pushes_down(spark, tmp_path, monkeypatch):
    import gzip
    import io

    big = warc.record("response", "<urn:page:1>", "http://a", b"p" * 500_000, 500_000, "D1")
    small = warc.record("revisit", "<urn:page:2>", "http://b", None, 500_000, "D1", "<urn:page:1>")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    for name, data in {"own.warc.gz": warc.member(big) + warc.member(small) + warc.member(info), "other.warc.gz": gzip.compress(big) + gzip.compress(small) + gzip.compress(info), "plain.warc": big + small + info}.items():
        (tmp_path / name).write_bytes(data)
        seen = [(r.headers["warc-type"], len(r.payload())) for r in warc.records(io.BytesIO(data), lambda h: True)]
        assert seen == [("response", 500_000), ("revisit", 0), ("warcinfo", 4)], name
        only = [r.headers["warc-refers-to"] for r in warc.records(io.BytesIO(data), lambda h: h["warc-type"] == "revisit")]
        assert only == ["<urn:page:1>"], name
    rows = warc.read_warc(spark, f"file://{tmp_path}", ["warc_type", "record_id", "payload_bytes"]).where("warc_type = 'response'")
    assert sorted(r.payload_bytes for r in rows.collect()) == [500_000] * 3
    assert " Filter " not in rows._jdf.queryExecution().executedPlan().toString()  # the reader has taken the predicate
    assert warc.read_warc(spark, f"file://{tmp_path}").where("warc_type in ('warcinfo', 'revisit') and target_uri = 'http://b'").count() == 3
    inflated = []
    plain = warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *a: inflated.append(1) or plain(*a))
    data = warc.member(big) * 3
    assert sum(1 for _ in warc.records(io.BytesIO(data), lambda h: False)) == 0 and len(inflated) == 3


def test_warc_paths_ranges_and_torn_archives(spark, tmp_path, monkeypatch):
    import io

    rng = random.Random(4)
    all_records = [warc.record("response", f"<urn:page:{i}>", "http://a", p := rng.randbytes(rng.randint(0, 9000)), len(p), "D") for i in range(300)]
    data = b"".join(map(warc.member, all_records))
    for step in (1000, 50_000, len(data)):
        seen = [r.headers["warc-record-id"] for at in range(0, len(data), step) for r in warc.records(io.BytesIO(data), lambda h: True, at, min(len(data), at + step))]
        assert seen == [f"<urn:page:{i}>" for i in range(300)], step
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(data[: len(warc.member(all_records[0]))])
    assert warc.read_warc(spark, f"file://{tmp_path}", ["record_id"]).count() == 301
    assert warc.read_warc(spark, f"file://{tmp_path}/b.warc.gz", ["record_id"]).count() == 1
    with pytest.raises(Exception, match="missing"):
        warc.read_warc(spark, f"file://{tmp_path}/missing", ["record_id"]).count()
    big = warc.member(warc.record("response", "<urn:page:1>", "http://a", rng.randbytes(100_000), 100_000, "D"))
    (tmp_path / "torn.warc.gz").write_bytes(big[:50_000])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_warc(spark, f"file://{tmp_path}/torn.warc.gz", ["payload_bytes"]).collect()


def test_warc_of_many_copies_and_clashing_columns(spark):
    rows = [(i, f"http://x/{i}", "same" if i % 3 else f"own {i}", "clash", "clash") for i in range(5, 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    first = min(i for i in got if i % 3)
    assert len(got) == 295 and all(r.refers_to == (first if i % 3 and i != first else None) for i, r in got.items())


# 3: toxicity


def toxic_corpus(n, rng):
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = prose(rng.randint(20, 120), rng).split()
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["grobblix", "snarfulent", "Vexomire"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_learns_and_holds_out(spark):
    texts, y = toxic_corpus(400, random.Random(2))
    d, l = docs(spark, texts), spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = toxicity.train(d, l, learn=F.col("doc_id") < 300)
    got = {r.doc_id: r for r in toxicity.toxicity(d, model).collect()}
    assert all(got[i].predicted == y[i] for i in range(300, 400)) and all(0 <= r.score <= 1 for r in got.values())
    long = docs(spark, [prose(20_000), prose(20_000) + " grobblix snarfulent vexomire"])
    assert [r.predicted for r in toxicity.toxicity(long, model).orderBy("doc_id").collect()] == [0, 1]
    odd_rows = toxicity.toxicity(odd(spark), model).collect()
    assert len(odd_rows) == 8 and all(r.predicted == 0 for r in odd_rows)
    kept = toxicity.without_toxic(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == 8
    assert toxicity.toxicity(d.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    d, none = docs(spark, ["a b c", None]), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(d, toxicity.train(d, none)).collect()] == [0, 0]
    one = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.toxicity(d, toxicity.train(d, one)).collect()] == [1, 1]


def test_present_features_equal_a_plain_loop():
    import pyarrow as pa

    texts = ["Ab c", "", "abcabc", "éx"]
    row, feature = toxicity.present(*buffers(pa.array(texts)), np.ones(1 << toxicity.BITS, bool))
    for i, t in enumerate(texts):
        padded = b" " + t.translate(LOWER).encode() + b" "
        grams = {padded[k : k + n] for n in toxicity.ORDERS for k in range(len(padded) - n + 1)}
        assert (row == i).sum() <= len(grams) and (row == i).sum() >= len(grams) - 1


# 4: language model


def modified_kneser_ney(train, test, order):
    """Plain dictionaries: tokens, known tokens, base and score of each test text."""
    many = lambda values: [sum(v == i for v in values) for i in (1, 2, 3, 4)]
    cut = lambda n, d: 0.0 if n == 0 else n - d[min(n, 3) - 1]

    def grams(t):
        seq = ["<s>"] * (order - 1) + [*tokens(t), "</s>"]
        return [tuple(seq[i : i + order]) for i in range(len(seq) - order + 1)]

    counts = [Counter(g for t in train for g in grams(t))]
    known = Counter(g[-1] for t in train for g in grams(t))
    for _ in range(order - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    d = [kneser_ney.discounts(many(c.values())) for c in counts]
    followers = [defaultdict(list) for _ in counts]
    for c, f in zip(counts, followers, strict=True):
        for g, n in c.items():
            f[g[:-1]].append(n)
    v, n_all = len(known), sum(known.values())

    def probability(g):
        k = len(g) - 1
        lower = probability(g[1:]) if k else 1 / (v + 1)
        after = followers[k][g[:-1]]
        return cut(counts[k][g], d[k]) / sum(after) + sum(d[k][min(n, 3) - 1] for n in after) / sum(after) * lower if after else lower

    out = []
    for t in test:
        own = grams(t)
        base = sum(math.log10((known[g[-1]] + 0.5) / (n_all + 0.5 * (v + 1))) for g in own)
        out.append((len(own), sum(known[g[-1]] > 0 for g in own), base, sum(math.log10(probability(g)) for g in own)))
    return n_all, out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_equals_plain_counts(spark, order):
    rng = random.Random(8)
    few = WORDS[:40]
    texts = [" ".join(rng.choice(few) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["The  the THE", "", None, "unseen words only"]
    texts += [f"{few[0]} {few[1]} {few[2]} {few[3]} {w}" for w in few[:12]]
    train = [t for i, t in enumerate(texts) if i % 5 != 1]
    d = docs(spark, texts)
    model = kneser_ney.train(d.where("doc_id % 5 <> 1"), order=order)
    n, want = modified_kneser_ney(train, texts, order)
    assert model.tokens == n
    got = {r.doc_id: r for r in kneser_ney.score(d, model).collect()}
    for i, (tokens_, known, base, score) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known) == (tokens_, known) and r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-5)


def test_language_model_of_odd_rows(spark):
    empty = kneser_ney.train(odd(spark).limit(0))
    assert empty.tokens == 0 and all(math.isfinite(r.score) and r.n_known == 0 for r in kneser_ney.score(odd(spark), empty).collect())
    model = kneser_ney.train(odd(spark))
    got = kneser_ney.score(odd(spark), model).collect()
    assert len(got) == 8 and {r.doc_id: r.n_tokens for r in got}[4] == 200_001
    p = [r.score for r in kneser_ney.score(docs(spark, ["hello there", "there hello"]), model).orderBy("doc_id").collect()]
    assert p[0] > p[1]
    third = kneser_ney.train(odd(spark).limit(0), order=3)
    assert third.tokens == 0 and all(math.isfinite(r.score) and r.n_known == 0 for r in kneser_ney.score(odd(spark), third).collect())
    with pytest.raises(ValueError):
        kneser_ney.train(odd(spark), order=1)


# 5 and 10: sharding and mixing


def test_shards_match_the_mixture(spark):
    sources = ["a"] * 70 + ["b"] * 29 + [None] * 7 + ["c"] * 1
    texts = [None if i % 11 == 0 else "t%d" % (i % 20) for i in range(107)]
    got = sharding.proportional_shards(docs(spark, texts, sources=sources), 10).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 107 and set(sizes) == set(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(n))
        for source, of in Counter(sources).items():
            assert abs(sum(r.source == source for r in got if r["shard"] == s) - of * n / 107) < 1.5
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    odd_rows = sharding.proportional_shards(odd(spark), 3).collect()
    assert sorted(r.position for r in odd_rows) == list(range(8))
    assert sharding.proportional_shards(odd(spark).limit(0), 3).count() == 0


def test_pfair_schedule_meets_windows():
    rng = random.Random(1)
    for _ in range(20):
        shares = mixing.quantised([rng.random() + 0.01 for _ in range(rng.randint(1, 12))], 64)
        assert sum(shares) == 64
        slots = mixing.schedule(shares)
        assert sorted(x for s in slots for x in s) == list(range(64))
        for p, s in zip(shares, slots, strict=True):
            for j, t in enumerate(s, 1):
                release, deadline = mixing.windows(j, p, 64)
                assert release <= t < deadline
            for t in range(65):
                assert abs(sum(x < t for x in s) - t * p / 64) < 1


def test_mixture_keeps_weights_and_rows(spark):
    sources = ["a"] * 90 + ["b"] * 45 + [None] * 12 + ["c"] * 3
    rng = random.Random(4)
    rng.shuffle(sources)
    d = docs(spark, ["x"] * 150, sources=sources)
    got = mixing.mixed(d, {"a": 1.0, "b": 2.0, "c": 1.0}, block=4, period=32).orderBy("position").collect()
    assert [r.position for r in got] == list(range(150)) and sorted(r.doc_id for r in got) == list(range(150))
    assert all(r.release <= r.slot < r.deadline for r in got)
    first = [r for r in got if r.phase == 0]
    share = mixing.quantised([1.0, 2.0, 1.0, 1.0], 32)
    for source, p in zip(["a", "b", None, "c"], [share[0], share[1], share[3], share[2]], strict=True):
        assert abs(sum(r.source == source for r in first) / 4 - p / 32 * (max(r.slot for r in first) + 1)) < 1.01
    assert sorted(r.position for r in mixing.mixed(odd(spark)).collect()) == list(range(8))
    assert mixing.mixed(odd(spark).limit(0)).count() == 0


def test_mixture_keeps_exact_weights_of_many_sources(spark):
    heavy = {f"s{i:03}": 10.0 if i == 0 else 1.0 for i in range(20)}
    many = {f"s{i:03}": float(1 + i % 3) for i in range(300)}
    for weights, rows in ((heavy, 400), (many, 20)):  # rows of a source: slots enough to show a drift, sources past 256
        n = len(weights) * rows
        d = spark.range(n).selectExpr("id doc_id", "'x' text", f"format_string('s%03d', id % {len(weights)}) source")
        got = mixing.mixed(d, weights, block=1, period=5000).orderBy("position").collect()
        assert [r.position for r in got] == list(range(n)) and len({r.doc_id for r in got}) == n
        total, seen = int(sum(weights.values())), Counter()
        for r in got:
            if r.phase == 0:
                seen[r.source] += 1
                assert all(abs(seen[s] * total - int(weights[s]) * (r.position + 1)) < total for s in weights)
    counts = [33_333] + [3_508] * 19
    target, seen = [n**0.5 for n in counts], Counter()
    for source, _, phase, _, _, slot, _ in mixing.planned(counts, target):
        if phase == 0:
            seen[source] += 1
            assert all(abs(seen[i] - w / sum(target) * (slot + 1)) < 1 + 1e-6 for i, w in enumerate(target))


def test_mixture_takes_filters_weights_of_zero_and_other_columns(spark):
    d = docs(spark, ["x"] * 90, sources=["a"] * 40 + ["b"] * 30 + ["c"] * 20)
    got = mixing.mixed(d, {"a": 1.0, "b": 3.0, "c": 0.0}, block=2)
    rows = got.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(90)) and {r.source for r in rows[:70]} == {"a", "b"} and all(r.source == "c" for r in rows[70:])
    for column in got.columns:
        some = rows[7][column]
        assert got.where(F.col(column) == some).count() == sum(r[column] == some for r in rows)
    assert got.where("position < 60").count() == 60 and got.where("slot < 5 and phase = 0").count() == 10
    with pytest.raises(ValueError):
        mixing.mixed(d, {"a": -1.0})


def test_schedule_equals_a_plain_search():
    """Every slot holds, of the blocks whose release has come, one with the earliest deadline."""
    from fractions import Fraction

    for weights in ([0.5, 0.3, 0.2], [1.0] * 7, [0.97, 0.02, 0.01], [n**0.5 for n in (900, 30, 5, 1)]):
        counts = [200] * len(weights)
        exact = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
        done = [0] * len(weights)
        for source, block, phase, release, deadline, slot, before in mixing.planned(counts, weights, 1):
            if phase:
                break
            windows = [(done[i] / w // 1, -(-(done[i] + 1) // w)) for i, w in enumerate(exact)]
            assert (release, deadline) == windows[source] and release <= slot < deadline and before == slot and block == done[source]
            assert deadline == min(d for r, d in windows if r <= slot)
            done[source] += 1


def test_shards_equal_a_plain_sort(spark):
    rng = random.Random(7)
    sources = [rng.choice("aaab") if i % 9 else None for i in range(300)]
    texts = [f"t{i % 40}" for i in range(300)]
    got = {r.doc_id: (r.position, r["shard"], r.slot) for r in sharding.proportional_shards(docs(spark, texts, sources=sources), 7).collect()}
    key = {i: hashlib.md5(f"shards:{i}:{zlib.crc32(texts[i].encode())}".encode()).hexdigest() for i in range(300)}
    at = {}
    for s in set(sources):
        own = sorted((i for i in range(300) if sources[i] == s), key=key.get)
        at |= {i: ((k + 0.5) / len(own), s is not None, s or "", key[i]) for k, i in enumerate(own)}
    order = sorted(range(300), key=at.get)
    want = {}
    for p, i in enumerate(order):
        shard = p * 7 // 300
        want[i] = (p, shard, sum(q * 7 // 300 == shard for q in range(p)))
    assert got == want


# 7: language


def test_language_network(spark):
    rng = random.Random(6)
    kinds = {"aa": ["ka", "to", "mi", "zu"], "bb": ["él", "ro", "ss", "ün"], "cc": ["th", "ing", "ed", "er"]}
    rows = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40)), lang, "s", 1))
    d = spark.createDataFrame(rows, SCHEMA)
    net = language.train(d, learn=F.col("doc_id") < 180)
    got = {r.doc_id: r for r in language.languages(d, net).collect()}
    assert sum(got[i].lang_pred == rows[i][2] for i in range(180, 240)) >= 58
    assert all(0 <= r.score <= 1 for r in got.values())
    strange = {r.doc_id: r for r in language.languages(odd(spark), net).collect()}
    assert [strange[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and strange[4].lang_pred != "und"
    assert language.languages(d.limit(0), net).count() == 0
    assert language.train(d.limit(0)) is None and {r.lang_pred for r in language.languages(d, None).collect()} == {"und"}


def test_backpropagation_equals_numeric_gradient():
    rng = np.random.default_rng(0)
    part = language.Direction(*((rng.standard_normal(n) * 0.3).astype(np.float32) for n in ((6, 256), (6, 3))))
    x, aim = rng.integers(60, 64, (5, 2)), rng.standard_normal((5, 3, 2))

    def loss(p):
        h, total = np.zeros((3, 2)), 0.0
        for t in range(5):
            z = np.tanh(p.state @ h + p.inputs[:, x[t]])
            gate = (z[:3] + 1) / 2
            h = gate * h + (1 - gate) * z[3:]
            total += (h * aim[t]).sum()
        return total

    states = part.run(x).astype(float)
    d_inputs, d_state = part.learn(x, states, aim)
    for name, grad in (("inputs", d_inputs), ("state", d_state)):
        for i, j in ((0, 61 if name == "inputs" else 1), (4, 62 if name == "inputs" else 2)):
            array = getattr(part, name)
            array[i, j] += 1e-2
            up, above = loss(part), float(array[i, j])
            array[i, j] -= 2e-2
            down, below = loss(part), float(array[i, j])
            array[i, j] += 1e-2
            assert grad[i, j] == pytest.approx((up - down) / (above - below), rel=1e-2, abs=1e-3)


# 8: HTML


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a>More</a></li></ul></nav>
    <!-- x --><div class="ad">Buy this thing now, it is really very good for you.</div><article><h1>A &amp; B</h1><p><b>First paragraph with  several words<br>and a
    break in it.<p>Second one &copy; here, also with quite a few words.</p><div class="comments"><p>I do not agree with this article at all, in many words.</p></div></article>
    <script>var t="</p><p>not text</p>";</script><form>Name <input></form><footer>&copy; 2020 somebody</footer>"""
    assert html_text.extract(page) == "A & B\nFirst paragraph with several words and a break in it.\nSecond one © here, also with quite a few words."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<article><p>" + "word " * 50_000), (5, "u", "<!-- never closed <p>x</p>"), (None, "u", "<script>x")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.n_chars for r in got if r.page_id in (2, 3, 4, None)) == [0, 0, 0, 0] and max(r.n_chars for r in got) == 50_000 * 5 - 1


WORD = "word " * 150
PAGES = {
    "a name that speaks against long text": (f'<div class="social-history"><h2>A title</h2><p>{WORD}</p><p>{WORD}</p></div>', ["A title", WORD, WORD]),
    "a lead and a caption": (f'<article><h1>T</h1><p class="teaser">{"lead " * 25}</p><figure><img><figcaption>The caption here</figcaption></figure><p>{WORD}</p></article>', ["T", "lead " * 25, "The caption here", WORD]),
    "a button left open": (f"<article><p>{WORD}</p><button>go<p>more words that follow here</p></article>", [WORD, "go", "more words that follow here"]),
    "a list without marks": (f"<div><h1>Title words</h1><p>{WORD}</p><ul><li>first thing to do now</li><li>second thing to do</li></ul></div>", ["Title words", WORD, "first thing to do now", "second thing to do"]),
    "reader comments": (f'<main><p>{WORD}</p><section id="comments"><h3>Replies</h3><p>{WORD}</p></section></main>', [WORD]),
    "menus without marks": (f'<div><ul><li><a href="/">Home</a></li><li><a href="/b">News of today</a></li></ul></div><p>{WORD}</p><p><a href="/n">Read the next one</a></p>', [WORD]),
    "a script and a drawing": (f'<article><svg><text>no</text></svg><script>if (a<b) "</p>"</script><p>{WORD}</p><style>p</style><!-- c --></article>', [WORD]),
    "an aside, a form and a footer": (f"<p>{WORD}</p><aside><p>{WORD}</p></aside><form><p>Your name here please</p></form><footer>one two three</footer>", [WORD]),
    "signs in the text": (f"<article><p>{WORD} 1 < 2 &amp;&lt; <3</p></article>", [WORD + "1 < 2 &< <3"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_a_page(name):
    page, want = PAGES[name]
    assert html_text.extract(page) == "\n".join(x.strip() for x in want)


def test_pages_are_scanned_once():
    import time

    for unit in ('<a x="', "<a x='\"", "<button>", "</div>", "<div>", "<!--x", "<", '<p class="', "<script", "<svg>a", '"<a b=">'):
        began = time.process_time()
        html_text.extract(unit * (1_000_000 // len(unit)))
        assert time.process_time() - began < 10, unit  # looking back would take hours


def plain_article(page):
    """The text of a synthetic page's article, tag by tag."""
    import html as h

    body = page[page.index("<article>") + 9 :]
    body = re.sub(r"<!--.*?-->", "", body[: min(x for x in (body.find("</article>"), body.find("<footer>"), len(body)) if x >= 0)], flags=re.S).replace("<br>", " ")
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", body)
    parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"</?[a-z][^>]*>", "", x))).strip() for x in parts]
    return "\n".join(x for x in parts if x)


def test_main_text_equals_the_articles_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    extra = pages.selectExpr("*", "'clash' text", "0 n_chars", "'x' zone")
    assert {r.page_id: r.text for r in html_text.main_text(extra).collect()} == want


def test_tree_fits_its_table():
    assert all(html_text.decide(html_text.TREE, r[:-1]) == r[-1] for r in html_text.TABLE)


# 9: fingerprints


def sets_of(text, size=5):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_fingerprints_of_neighbours(spark):
    rng = random.Random(9)
    texts = [prose(rng.randint(0, 300), rng) for _ in range(30)] + ["", None, "a b", "é\U0001f600" * 7]
    texts[5] = texts[4]
    ids = [i * i for i in range(len(texts))]
    rows = fingerprints.edited_fingerprints(docs(spark, texts, ids))
    near = {r.doc_id: r for r in rows.withColumn("e", fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("x", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch"))).collect()}
    order = sorted(range(len(texts)), key=lambda i: -ids[i])
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        m = len(own) // 3
        edit = own[: len(own) - m] + after[:m]
        r = near[ids[i]]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        for got, other in ((r.e, edit), (r.x, after)):
            a, b = sets_of(own), sets_of(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert got == pytest.approx(exact, abs=1e-9 if len(a | b) <= fingerprints.K else 0.2)
    assert near[16].sketch == near[25].sketch


def test_sketches_merge_and_estimate(spark):
    w = [f"w{i}" for i in range(6000)]
    whole, first, second = " ".join(w), " ".join(w[:3000]), " ".join(w[2996:])
    s = {r.doc_id: r.sketch for r in fingerprints.fingerprints(docs(spark, [whole, first, second, "a b c d e f", None])).collect()}
    one = spark.createDataFrame([(s[0], s[1], s[2], s[3], s[4])], "w array<long>, a array<long>, b array<long>, c array<long>, e array<long>")
    r = one.select(
        (fingerprints.merge(F.col("a"), F.col("b")) == F.col("w")).alias("same"), fingerprints.distinct_count(F.col("w")).alias("n"), fingerprints.distinct_count(F.col("c")).alias("few"),
        fingerprints.containment(F.col("a"), F.col("w")).alias("inside"), fingerprints.resemblance(F.col("a"), F.col("w")).alias("like"),
        fingerprints.resemblance(F.col("e"), F.col("e")).alias("empty"), fingerprints.resemblance(F.col("e"), F.col("c")).alias("none"), (fingerprints.from_text(fingerprints.to_text(F.col("w"))) == F.col("w")).alias("text"),
    ).first()
    assert r.same and r.text and r.few == 2.0 and r.empty == 1.0 and r.none == 0.0
    assert abs(r.n - 5996) < 5996 * 0.3 and r.inside > 0.8 and abs(r.like - 0.5) < 0.15
    parts = spark.createDataFrame([(1, s[1]), (1, s[2]), (2, s[3]), (3, []), (None, s[3])], "g int, x array<long>")
    assert {r.g: r.x for r in fingerprints.merged(parts, "g", "x").collect()} == {1: s[0], 2: s[3], 3: [], None: s[3]}


@pytest.mark.parametrize("shape", ["far", "one id", "no ids"])
def test_fingerprints_of_uneven_ids(spark, monkeypatch, shape):
    """Ranges stay even, and neighbours right, with a far-off id, with one id on many rows, and without ids."""
    monkeypatch.setattr(fingerprints, "_BUCKET_ROWS", 10)
    monkeypatch.setattr(fingerprints, "_STEP", 4)
    rng = random.Random(2)
    n = 400
    ids = {"far": [*range(n - 2), 10**15, -(10**17)], "one id": [7] * 150 + list(range(n - 150)), "no ids": [None] * 300 + list(range(n - 300))}[shape]
    texts = [prose(rng.randint(1, 12), rng) for _ in range(n)]
    rows = fingerprints.edited_fingerprints(docs(spark, texts, ids))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows.collect())
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", F.xxhash64("t")).collect()}
    order = sorted(range(n), key=lambda i: (ids[i] is None, -(ids[i] or 0), hashes[texts[i]]))
    want = Counter()
    for k, i in enumerate(order):
        own, after = texts[i], texts[order[(k + 1) % n]]
        m = len(own) // 3
        want[ids[i], len(own), hashlib.sha256((own[: len(own) - m] + after[:m]).encode()).hexdigest()] += 1
    assert got == want


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.edited_fingerprints(odd(spark)).collect()
    assert len(got) == 8 and {r.doc_id: r.n_chars for r in got}[4] == 400_000
    assert fingerprints.edited_fingerprints(odd(spark).limit(0)).count() == 0
    assert len({tuple(r.sketch) for r in got if r.doc_id == 5}) == 1


# The queries


def test_queries_cover_the_ten_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs_over_the_whole_table(spark, name):
    rows = registry.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) == {"op1": len(rows), "op2": 50, "op8": 50}.get(name.split("_")[0], 200)


def test_workers_hold_small_pieces_and_give_memory_back():
    import tracemalloc

    import pyarrow as pa

    from quarrykit.llm import textcore

    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(999)]
    texts = [" ".join(rng.choices(vocabulary, k=500)) for _ in range(4000)]
    ids = pa.array(range(len(texts)))
    model = toxicity.Classifier(np.arange(0, 1 << 20, 20, dtype=np.int32), np.ones(52429, np.float32), 0.0)
    for run, names in ((toxicity._score(model), ["id", "text"]), (near_dups._describe(5, 24, 4), ["id", "text_hash", "text"])):
        batch = pa.RecordBatch.from_arrays([*[ids] * (len(names) - 1), pa.array(texts)], names)
        tracemalloc.start()
        got = sum(x.num_rows for x in textcore.lean(run)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == len(texts) and most < 40e6  # pieces of 4 MB took 96 and 132 MB here
