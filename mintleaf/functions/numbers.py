"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mintleaf.functions.arrays import let


def half_even(x: Column, digits: int) -> Column:
    """Rounds to ``digits`` decimals, ties to even (the rule of numpy)."""
    return F.rint(x * 10**digits) / 10**digits


def ratio(part: Column, whole: Column, zero: float = 0.0) -> Column:
    """part / whole as double; ``zero`` where the whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(zero)).otherwise(part.cast("double") / whole)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return half_even(100 * ratio(part, whole), digits)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def softmax(margins: Column) -> Column:
    """Softmax of an array of doubles; the exponentials and their sum are made once."""
    powers = let(F.array_max(margins), lambda most: F.transform(margins, lambda m: F.exp(m - most)))
    total = lambda es: F.aggregate(es, F.lit(0.0), lambda a, e: a + e)
    return let(powers, lambda es: let(total(es), lambda s: F.transform(es, lambda e: e / s)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
