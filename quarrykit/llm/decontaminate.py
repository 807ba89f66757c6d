"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, units after numbers, and names (capitalised words but for common function words; a run of them is one name)
become typed placeholders, so a question asked again with other values keeps its template. Windows of five template
tokens of all documents are hash-joined with those of the benchmark; a window with fewer than three words that aren't
placeholders says nothing as a template, so it counts with its own values. An item of three or four tokens is one window
of its own length, and documents are cut into such windows too if there are such items; shorter items aren't searched.

An item leaks into a document if the document holds at least ``coverage`` of the item's windows and the slots agree:
the values of the item and those of the document have to stand for each other one to one (``agreement`` is the share of
slots in which each value meets its most common partner, the lesser of both directions). A document may hold an item
several times with different values, so besides the whole document each occurrence is judged on its own: the hits on
one diagonal (place in the document less place in the item), and those on diagonals at most ``slack`` apart, which an
edited copy is spread over. One that passes is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SIZE, LITERALS, COVERAGE, AGREEMENT, SLACK = 5, 3, 0.5, 0.8, 5
#: Windows of the benchmark up to which it is broadcast (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000

UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|mph|kmh|s|ms|min|h|hr|hrs|sec|seconds?|minutes?|hours?|days?|weeks?|months?|years?|grams?|kilograms?|kilomet(?:er|re)s?|met(?:er|re)s?|centimet(?:er|re)s?|miles?|feet|foot|inch(?:es)?|pounds?|ounces?|lit(?:er|re)s?|l|ml|dollars?|cents?|euros?|percent|degrees?|watts?|volts?|gb|mb|kb|tb"
#: Words that are no names though a sentence may begin with them.
FUNCTION_WORDS = "The|A|An|This|That|These|Those|There|Here|It|He|She|They|We|You|His|Her|Their|Its|My|Our|Your|If|When|While|After|Before|Since|Because|Although|As|At|By|For|From|In|Into|Of|On|Over|Under|To|With|Without|And|But|Or|So|Then|Not|No|Each|Every|All|Some|Any|Both|One|Two|Three|What|Which|Who|Whom|Whose|Where|Why|How|Is|Are|Was|Were|Do|Does|Did|Can|Could|Will|Would|Should|May|Let|Given|Find|Compute|Solve|Show|Yesterday|Today|Later|Der|Die|Das|Ein|Eine|Wie|Was|Wer|Wo|Und|Le|La|Les|Un|Une|El|Los|Las|Una|Que|Quel|Quelle|Comment"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_WITH_UNIT = rf"(?i)({_NUMBER})\s?((?:{UNITS})\b|[%€£°])"
#: The capital comes first, so that most places are passed over at once; what must not stand before or here follows it.
_NAME = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}\x03].)(?<=(?!(?:{FUNCTION_WORDS})(?!\p{{L}})).)\p{{Ll}}+(?![\p{{L}}\p{{N}}])"
_SPLIT = r"[^\p{L}\p{N}\x01-\x04]+"
#: Marks before number, unit and name slots; each stands before its value.
MARKS = "\x02\x03\x04"


def _plain(text: Column) -> Column:
    """The text without the characters that serve as marks."""
    return F.regexp_replace(text, "[\x01-\x05]", " ")


def tokens(text: Column) -> Column:
    """The tokens of a text: words in lower case, placeholders as a mark with the value (dots, commas and the like in
    values, and blanks within a name, as \\x01)."""
    value = F.regexp_replace(F.regexp_replace(text, _WITH_UNIT, " \x02$1 \x03$2 "), rf"(?<![\x020-9.,:/]){_NUMBER}", " \x02$0 ")
    value = F.regexp_replace(value, r"(?<=[0-9])[.,:/](?=[0-9])", "\x01")
    value = F.regexp_replace(F.regexp_replace(value, "\x03%", "\x03percent"), "\x03([€£°])", "\x03sign")
    value = F.when(text.rlike("[0-9]"), value).otherwise(text)
    value = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, _NAME, " \x04$0\x05 "), r"\x05\s+\x04", "\x01"), "\x05", "")
    return F.filter(F.split(F.lower(value), _SPLIT), lambda x: x != "")


def _windows(df: DataFrame, keys: list[str], sizes: list[int], literals: int, own: bool = False) -> DataFrame:
    """(keys, pos, h, len): the windows of the tokens in column ``t``, of each of ``sizes`` tokens; with ``own`` of the
    last size, or if there are fewer tokens, of all of them."""
    value, word = "xxhash64(x)", "x >= '\x05'"
    rows = df.select(*keys, F.expr(f"transform(t, x -> struct({value} as v, if({word}, {value}, xxhash64(substring(x, 1, 1))) as u, int({word}) as w))").alias("z"))

    def of(size: int) -> str:
        every = range(size)
        h = f"if({' + '.join(f'z[i + {j}].w' for j in every)} >= {literals}, xxhash64({', '.join(f'z[i + {j}].u' for j in every)}), xxhash64({', '.join(f'z[i + {j}].v' for j in every)}))"
        fits = f"size(z) = {size}" if own and size != sizes[-1] else f"size(z) >= {size}"
        return f"case when {fits} then transform(sequence(0, size(z) - {size}), i -> struct(i as pos, {h} as h, {size} as len)) end"

    each = [F.coalesce(F.expr(of(s)), F.expr("cast(array() as array<struct<pos: int, h: bigint, len: int>>)")) for s in sizes]
    # The outer form: else Spark infers a filter on the array, and works out all windows a second time for it.
    return rows.select(*keys, F.explode_outer(F.concat(*each) if len(each) > 1 else each[0]).alias("at")).where("at is not null").select(*keys, "at.*")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, literals: int = LITERALS, coverage: float = COVERAGE, agreement: float = AGREEMENT, slack: int = SLACK) -> DataFrame:
    """(id, item_id, found, of, coverage, slots, agreement): one row for each item found in a document, of the whole
    document where that passes, else of its best occurrence.

    Null and empty texts hold nothing; rows without an id are left out; rows that repeat an id count together; items
    that repeat an id are parts of one item; items of fewer than ``literals`` tokens are found nowhere. Empty tables
    give no rows.
    """
    source = docs.select(F.col(id_col).alias("doc"), _plain(F.col(text_col)).alias("text")).where("doc is not null and text is not null").withColumn("row", F.xxhash64("text"))
    items = stored(benchmark.select(F.col(item_col).alias("item"), _plain(F.col(item_text)).alias("text")).where("item is not null and text is not null"), "items")
    sizes = list(range(min(literals, size), size + 1))
    telling = stored(_windows(items.select("item", tokens(F.col("text")).alias("t")), ["item"], sizes, literals, own=True).withColumnRenamed("pos", "q"), "benchmark")
    lengths = {r["len"]: r["count"] for r in telling.groupBy("len").count().collect()}  # at most ``size`` rows
    wanted = F.broadcast(telling) if sum(lengths.values()) <= BROADCAST_ROWS else telling
    here = _windows(source.select("doc", "row", tokens(F.col("text")).alias("t")), ["doc", "row"], sorted(lengths) or [size], literals)
    hits = stored(here.join(wanted, ["h", "len"]).select("doc", "row", "item", "pos", "q", "h", "len"), "hits")
    needed = telling.groupBy("item").agg(F.countDistinct("h").alias("of"))
    found = hits.select("doc", "item", "h").distinct().groupBy("doc", "item").agg(F.count("*").alias("found"))
    found = found.join(needed, "item").where(F.col("found") / F.col("of") >= coverage).select("doc", "item", "of")
    found = stored(found, "found")
    # Where it may be found: in the whole document (0), along a band of diagonals (1), along one diagonal (2).
    start = F.col("pos") - F.col("q")
    along = Window.partitionBy("doc", "row", "item").orderBy("start")
    likely = hits.join(found, ["doc", "item"]).withColumn("start", start)
    likely = likely.withColumn("gap", F.coalesce((F.col("start") - F.lag("start").over(along) > slack).cast("int"), F.lit(0)))
    likely = likely.withColumn("band", F.sum("gap").over(along))  # a running sum with ties: rows of one diagonal share a band
    places = F.array(*[F.struct(F.lit(k).alias("kind"), row.cast("long").alias("row"), at.cast("long").alias("at")) for k, row, at in ((0, F.lit(0), F.lit(0)), (1, F.col("row"), F.col("band")), (2, F.col("row"), F.col("start")))])
    likely = likely.select("doc", "row", "item", "pos", "q", "h", "len", "of", F.explode(places).alias("place"))
    found = likely.groupBy("doc", "item", "place", "of").agg(F.countDistinct("h").alias("found"))
    found = stored(found.withColumn("coverage", F.col("found") / F.col("of")).where(F.col("coverage") >= coverage), "places")
    # The slots of what was found: value of the item against value of the document, offset by offset.
    offsets = F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("o")
    at = likely.join(found.select("doc", "item", "place"), ["doc", "item", "place"], "left_semi").select("doc", "row", "item", "place", "pos", "q", offsets)
    at = at.select("doc", "row", "item", "place", (F.col("pos") + F.col("o")).alias("p"), (F.col("q") + F.col("o")).alias("q")).distinct()

    def slots(rows: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
        every = rows.select(*keys, F.posexplode_outer(tokens(F.col("text"))).alias(place, value))
        return every.where(F.substring(value, 1, 1).isin(*MARKS))

    suspects = source.join(found.select("doc").distinct(), "doc", "left_semi")
    pairs = at.join(slots(items, ["item"], "q", "theirs").distinct(), ["item", "q"]).join(slots(suspects, ["doc", "row"], "p", "ours").distinct(), ["doc", "row", "p"])
    votes = stored(pairs.groupBy("doc", "item", "place", "theirs", "ours").agg(F.count("*").alias("n")), "votes")

    def one_way(value: str) -> DataFrame:
        most = votes.groupBy("doc", "item", "place", value).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
        return most.groupBy("doc", "item", "place").agg(F.sum("n").alias("slots"), (F.sum("most") / F.sum("n")).alias("agreement"))

    back = one_way("ours").select("doc", "item", "place", F.col("agreement").alias("back"))
    agreed = one_way("theirs").join(back, ["doc", "item", "place"]).withColumn("agreement", F.least("agreement", "back")).drop("back")
    out = found.join(agreed, ["doc", "item", "place"], "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0))).where(F.col("agreement") >= agreement)
    best = F.min_by(F.struct("found", "of", "coverage", F.coalesce("slots", F.lit(0)).alias("slots"), "agreement"), F.struct(F.least("place.kind", F.lit(1)), -F.col("coverage"), -F.col("agreement"), "place"))
    return out.groupBy("doc", "item").agg(best.alias("best")).select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "best.*")
