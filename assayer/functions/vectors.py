"""Dense vectors as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import d


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, d(0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, d(0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with ``value`` worked out once, however often the lambdas in ``make`` use it."""
    return F.transform(F.array(value), make)[0]


def normalised(a: Column) -> Column:
    return bound(a, lambda v: bound(norm(v) + d(1e-9), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def hashed_vector(tokens: Column, size: int = 256) -> Column:
    """A unit vector of hashed token counts with hashed signs: the encoder where no model is at hand.

    Like any encoder it is a Column of the text, so a trained one in a pandas UDF takes its place.
    """
    places = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).alias("at"), F.when(F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2)) == 0, d(1)).otherwise(d(-1)).alias("sign")))
    zeros = F.array_repeat(d(0), size)
    counts = F.aggregate(F.array_sort(places), zeros, lambda v, p: F.transform(v, lambda x, i: F.when(i == p["at"], x + p["sign"]).otherwise(x)))
    return normalised(counts)
