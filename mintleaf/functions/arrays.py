"""Array column helpers whose work grows in proportion to the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least elements of a block of a running sum.
_BLOCK = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, wherever the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _running(sizes: Column, first: Column) -> Column:
    """``first``, first + sizes[0], and so on, without the last sum. The state grows, so for short arrays only."""
    start = F.struct(first.alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]


def sums_before(sizes: Column) -> Column:
    """For each element of an array of longs the sum of those before it.

    A fold that appends to its state copies it each time. Here blocks are summed, the sums are run over, and each block is
    run over from where it starts: an array of n elements in blocks of b costs some n * b + (n / b)^2 copies of a number,
    which are fewest where b is near the cube root of 2 * n. Null and empty arrays stay.
    """

    def of_blocks(values: Column, block: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(values), block)
        return let(
            F.transform(starts, lambda k: F.slice(values, k, block)),
            lambda blocks: F.flatten(F.zip_with(
                blocks, _running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0).cast("long")), _running,
            )),
        )

    length = lambda values: F.greatest(F.lit(_BLOCK), F.cbrt(2 * F.size(values)).cast("int"))
    return let(sizes, lambda values: F.when(F.size(values) > 0, let(length(values), lambda block: of_blocks(values, block))).otherwise(values))
