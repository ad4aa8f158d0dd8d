"""Column functions on numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; the shorter array counts as filled with zeros."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance; the shorter array counts as filled with zeros."""
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def l2_normalize(a: Column) -> Column:
    """Unit length; a vector of about no length stays as it is."""
    n = norm(a)
    return F.when(n < TINY, _double(a)).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def chunk_mean(a: Column, size: int) -> Column:
    """The mean of the whole chunks of ``size``; a shorter array is filled with zeros."""
    chunks = F.floor(F.size(a) / size).cast("int")
    filled = F.concat(_double(a), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0))))

    def mean_at(i: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1)
        return F.aggregate(places, F.lit(0.0), lambda s, c: s + F.element_at(filled, (c * size + i + 1).cast("int"))) / F.greatest(chunks, F.lit(1))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), mean_at)
