"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector over its length; a zero vector stays. The length is a field of a row of its own, so that it is not computed again for each number."""
    n = norm(a)
    once = F.array(F.struct(a.alias("a"), F.when(n == 0, 1.0).otherwise(n).alias("n")))
    return F.get(F.transform(once, lambda v: F.transform(v["a"], lambda x: x.cast("double") / v["n"])), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)
