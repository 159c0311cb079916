"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``.

    Lambdas would otherwise evaluate the outer expression again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_hex(key: Column, seed: int | str = 0) -> Column:
    """md5 of ``seed|key``: the same pseudo-random order on every engine and every retry."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_uint32(key: Column, seed: int | str = 0) -> Column:
    """First 32 bits of :func:`hash_hex` as a non-negative number."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("bigint")


def run_counts(values: Column) -> Column:
    """``array<struct<term, tf>>`` of an array's distinct values, sorted, without a shuffle.

    Sorts inside the row and measures the length of each run, so a text of n tokens costs
    n log n and needs no (id, token) aggregation.
    """

    def count(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda first, j: F.struct(
                    F.get(s, first).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - first).cast("bigint").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return bind(F.sort_array(values), lambda s: F.when(F.size(s) > 0, count(s)).otherwise(empty))
