"""Exact distinct counts of whole numbers in one aggregate.

``count(distinct x)`` next to other aggregates makes Spark aggregate by (group, x) first, one
more level and shuffle.  Unit numbers are small whole numbers: a bitmap of 32,768 bits per group
holds them, merges by OR, and keeps a group's partial state at 4 KB.  Numbers outside that range
are collected as a set next to it, so the count is exact for any numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32_768


def _inside(column: str) -> Column:
    return F.col(column).between(0, BITS - 1)


def number_bits(column: str) -> Column:
    """Aggregate: bitmap of the numbers below ``BITS``."""
    return F.bitmap_construct_agg(F.when(_inside(column), F.col(column).cast("bigint")))


def other_numbers(column: str) -> Column:
    """Aggregate: the numbers that have no bit."""
    return F.collect_set(F.when(~_inside(column), F.col(column)))


def distinct_numbers(column: str) -> Column:
    """Aggregate: exact distinct count of a whole-number column (NULL is no value)."""
    return F.bitmap_count(number_bits(column)) + F.size(other_numbers(column))
