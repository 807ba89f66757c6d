"""Bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles. The sketch
of a text cut into parts (each carrying the last four words of the part before) is the merge of the parts' sketches,
in any order. Sketches shorter than ``k`` hold the whole set, so everything estimated from them is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHINGLE = 128, 5
#: Rows that one range of ids is meant to hold, and the most ranges (beyond, ranges grow evenly).
_BUCKET_ROWS, _MOST_BUCKETS, _STEP = 512, 10_000, 100
_EMPTY = "cast(array() as array<bigint>)"


def with_sketch(df: DataFrame, text_col: str, out_col: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of a text column, any case alike, words as white space cuts them. A text with fewer
    words than ``size`` has its whole sequence as its one shingle; a null text or one without words an empty sketch."""
    w, h = f"_w_{out_col}", f"_h_{out_col}"
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    each = ", ".join(f"`{w}`[i + {j}]" for j in range(size))
    rolled = F.expr(f"case when size(`{w}`) >= {size} then transform(sequence(0, size(`{w}`) - {size}), i -> xxhash64({each})) when size(`{w}`) > 0 then array(xxhash64(`{w}`)) else {_EMPTY} end")
    df = df.withColumn(h, rolled)
    return df.withColumn(out_col, F.expr(f"slice(array_sort(array_distinct(`{h}`)), 1, {k})")).drop(w, h)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(sketches: DataFrame, group: str, sketch: str, k: int = K) -> DataFrame:
    """(group, sketch): the sketch of the union of all sketches of each group, however many they are. Hashes are made
    distinct before they meet, and each task passes on the ``k`` smallest of a group at most."""
    each = sketches.select(F.col(group).alias("g"), F.explode_outer(sketch).alias("h")).distinct()
    lowest = each.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("h").asc_nulls_last()))).where(F.col("r") <= k)
    return lowest.groupBy("g").agg(F.array_sort(F.collect_list("h")).alias("s")).select(F.col("g").alias(group), F.col("s").alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sets are alike (1), an empty and another one are not (0)."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k - 1) / (share of the hash range below the k-th smallest hash)."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    j = resemblance(a, b, k)
    size_a, size_b = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (size_a + size_b) / (1 + j) / F.greatest(size_a, F.lit(1.0))))


def to_text(a: Column) -> Column:
    """A sketch as base64 of its big-endian 64-bit numbers; an empty one as the empty string."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def from_text(text: Column) -> Column:
    """The sketch that ``to_text`` wrote."""
    digits = F.hex(F.unbase64(text))
    steps = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(16))).otherwise(F.expr("cast(array() as array<int>)"))
    wrap = F.lit(str(1 << 64)).cast("decimal(38,0)")

    def number(i: Column) -> Column:
        x = F.conv(F.substring(digits, i, F.lit(16)), 16, 10).cast("decimal(38,0)")
        return F.when(x >= F.lit(str(1 << 63)).cast("decimal(38,0)"), x - wrap).otherwise(x).cast("bigint")

    return F.transform(steps, number)


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, sketch) of every row."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_sketch(source, "_text", "sketch", k, size).select(F.col("_id").alias(id_col), "sketch")


def edited_fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's sketch beside that of its edited text and of the next document's text.

    The next document is the one with the next smaller integer id, after the smallest the largest. In the edited text
    the last floor(n / 3) code points are replaced by the first as many (or all) of the next document's text. Null
    texts are empty. Rows that repeat an id follow each other in the order of their text's hash; rows without an
    id come last. One row has itself as its next document; no rows give none.

    Ids are cut into ranges of about equally many rows, by quantiles, so gaps and far-off ids make none larger; rows without
    an id are cut by their text's hash. Each range gets a copy of the row that follows its last one. So every text moves
    once, to a window of one range, and neither one task nor the driver holds an unbounded share.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows_of, missing = source.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    ranges = lambda n: min(_MOST_BUCKETS, max(1, n // _BUCKET_ROWS))
    count = ranges(rows_of - missing)
    cuts = F.percentile_approx("id", [i / count for i in range(1, count)], 10 * count) if count > 1 else F.expr("cast(array() as array<bigint>)")
    bounds = sorted(set(source.agg(cuts).first()[0] or []))  # _MOST_BUCKETS numbers at most
    # The number of bounds up to the id, found in two steps: among every _STEP-th of them, then in the stretch before that.
    stretches = [bounds[i : i + _STEP] for i in range(0, len(bounds), _STEP)] or [[]]
    top = F.array(*[F.lit(x[0]) for x in stretches[1:]]).cast("array<bigint>")
    parts = docs.sparkSession.createDataFrame(list(enumerate(stretches)), "stretch int, bounds array<bigint>")
    up_to = lambda x: F.size(F.filter(x, lambda b: b <= F.col("id")))
    source = source.withColumn("h", F.xxhash64("text")).withColumn("stretch", F.coalesce(up_to(top), F.lit(0)))
    source = source.join(F.broadcast(parts), "stretch")
    by_hash = -1 - F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * ranges(missing)).cast("long")
    place = F.when(F.col("id").isNull(), by_hash).otherwise((F.col("stretch") * _STEP + up_to(F.col("bounds"))).cast("long"))
    source = source.select("id", "text", "h", place.alias("bucket"))
    # The first row of each range, to be copied to the range above it, and of the highest to the lowest.
    least = F.min(F.struct((-F.col("id")).alias("back"), "h"))  # the order within a range: falling ids, then rising hashes
    firsts = source.groupBy(F.col("bucket").alias("b")).agg(least.alias("first"))  # 2 * _MOST_BUCKETS rows at most
    line = Window.partitionBy(F.lit(0)).orderBy("b")
    firsts = firsts.select("b", "first.back", F.col("first.h").alias("first_h"), F.coalesce(F.lead("b").over(line), F.min("b").over(line)).alias("to"))
    is_first = (F.col("bucket") == F.col("b")) & (-F.col("id")).eqNullSafe(F.col("back")) & (F.col("h") == F.col("first_h"))
    source = source.join(F.broadcast(firsts), is_first, "left").drop("b", "back", "first_h")
    places = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("copy")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("copy")))))
    rows = source.select("id", "text", "h", F.explode(places).alias("p")).select("id", "text", "h", "p.bucket", "p.copy")
    order = Window.partitionBy("bucket").orderBy("copy", F.col("id").desc_nulls_last(), "h")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    n = F.length("text")
    kept = n - F.floor(n / 3)
    edited = F.concat(F.col("text").substr(F.lit(1), kept.cast("int")), F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), (n - kept).cast("int")))
    rows = rows.withColumn("edited", F.when(F.col("copy") == 0, edited)).drop("next_text")
    rows = with_sketch(with_sketch(rows, "text", "sketch", k), "edited", "edited_sketch", k)
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "edited")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order))  # sorted so already
    return rows.where("copy = 0").select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")
