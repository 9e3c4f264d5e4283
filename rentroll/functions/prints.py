"""Prints of rows and of bags of rows, by which content is compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_PART = 21  # bits; sums of parts stay below 2^63 for 2^41 rows


def row_hash(columns: Sequence[Column], seed: Column) -> Column:
    """A 64-bit hash of a row's values that tells a NULL from every value and a column from the next."""
    nulls = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        nulls = nulls + F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return F.xxhash64(seed, nulls, *columns)


def exact_sum(hashes: Column) -> Column:
    """Aggregate: the exact sum of 64-bit numbers, whatever their count; NULL without any.

    Whole numbers are added, in three parts, and put together at the end: adding up decimals of this width costs an
    object for each row.
    """
    low = F.sum(hashes.bitwiseAND((1 << _PART) - 1))
    middle = F.sum(F.shiftright(hashes, _PART).bitwiseAND((1 << _PART) - 1))
    high = F.sum(F.shiftright(hashes, 2 * _PART))

    def placed(part: Column, bits: int) -> Column:
        return part.cast("decimal(19,0)") * F.lit(str(1 << bits)).cast("decimal(13,0)")

    return (placed(high, 2 * _PART) + placed(middle, _PART) + low.cast("decimal(19,0)")).cast("decimal(38,0)")
