"""Dense vectors as arrays: cosine, slices, and character n-gram vectors of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def resized(a: Column, size: int) -> Column:
    """The first ``size`` numbers, filled up with zeros."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)


def grams(text: Column, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` characters of a text, the short ones first."""

    def of_size(n: int) -> Column:
        spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.substring(text, i, F.lit(n)))

    return F.flatten(F.array(*[of_size(n) for n in range(low, high + 1)]))


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Runs of ``low`` to ``high`` characters of the text without white space."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    return F.transform(F.array(plain), lambda x: grams(x, low, high))[0]


def hashed_vector(terms: Column, size: int = 256) -> Column:
    """Counts of the terms' hash buckets, scaled to length one; zeros without terms."""
    counts = F.aggregate(
        F.array_sort(F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))), F.array_repeat(F.lit(0.0), size),
        lambda acc, i: F.transform(acc, lambda v, k: v + F.when(k == i, 1.0).otherwise(0.0)),
    )
    return F.transform(counts, lambda v: v / F.greatest(F.sqrt(dot(counts, counts)), F.lit(1e-9)))
