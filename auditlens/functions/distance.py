"""Set-overlap distances between two token lists of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ngrams


def _gap(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def ngram_distance(a: Column, b: Column, n: int = 1) -> Column:
    """List sizes minus twice the set overlap of n-grams; null when a side is shorter than n."""
    return _gap(ngrams(a, n), ngrams(b, n))


def token_distance(a: Column, b: Column) -> Column:
    """:func:`ngram_distance` for n = 1, divided by the sum of the list sizes.

    Sizes count repeats, the overlap does not: a list with repeated tokens is at a positive
    distance from itself.
    """
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.try_divide(_gap(a, b), F.size(a) + F.size(b)))
