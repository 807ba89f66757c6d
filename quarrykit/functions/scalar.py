"""Scalar expressions: hashes, bit counts, encodings. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_modulo(text: Column, modulus: int) -> Column:
    """The text's UTF-8 bytes read as one big-endian integer, modulo ``modulus``; folding keeps it in 64 bits."""
    digits = F.hex(F.encode(text, "utf-8"))
    values = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    fold = F.aggregate(values, F.lit(0).cast("long"), lambda x, b: (x * 256 + b) % modulus)
    return F.when(F.length(digits) > 0, fold).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))


def linear_hash(x: Column, a: Column | int, b: Column | int, modulus: int) -> Column:
    """(a x + b) mod modulus for non-negative operands."""
    return (F.lit(a) * x + F.lit(b)) % modulus


def trailing_zeros(x: Column) -> Column:
    """Trailing zero bits of a non-negative integer; zero, written as one digit, has one."""
    return F.when(x == 0, 1).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("int")


def clean_number(text: Column) -> Column:
    """An integer from a quoted, zero-padded field; all zeros give 0, what is no number gives null."""
    return F.trim(F.regexp_replace(text, "^\"+|\"+$", "")).try_cast("double").cast("long")


def average_of_values(m: Column) -> Column:
    """The mean of a map's values, 0 for an empty or null map."""
    values = F.map_values(m)
    total = F.aggregate(values, F.lit(0.0), lambda x, y: x + y.cast("double"))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def bucketed(score: Column, edges: tuple[float, ...] = (1, 2, 3, 4)) -> Column:
    """The number of edges at or below the score: 0 for [..1), 1 for [1..2) and so on."""
    return reduce(lambda x, y: x + y, [F.when(score >= e, 1).otherwise(0) for e in edges])


#: What a noise level is worth; one that is absent or unknown, no attributes at all, an unknown place.
NOISE = {"quiet": 4.0, "average": 3.0, "loud": 2.0, "very_loud": 1.0}
NOISE_OTHER, NOISE_WITHOUT_ATTRIBUTES, NOISE_UNKNOWN = 3.0, 1.0, 2.0


def noise_score(attributes: Column, known: Column) -> Column:
    """The ordinal of ``attributes['NoiseLevel']``; ``known`` tells whether the place has a record."""
    level = attributes["NoiseLevel"]
    chain = reduce(lambda c, kv: c.when(level == kv[0], kv[1]), NOISE.items(), F.when(~known, NOISE_UNKNOWN).when(attributes.isNull(), NOISE_WITHOUT_ATTRIBUTES))
    return chain.otherwise(NOISE_OTHER)


def sentiment_bucket(mean: Column) -> Column:
    """Stars for a mean sentiment: below -0.5 half a star, below 0 two, below 0.5 three, else four and a half."""
    return F.when(mean < -0.5, 0.5).when(mean < 0, 2.0).when(mean < 0.5, 3.0).otherwise(4.5)
