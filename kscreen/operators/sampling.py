"""Samples and limits of reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenths(rate: float) -> int:
    """A rate is rounded up to the next tenth."""
    return min(10, math.ceil(round(rate * 10, 9)))


def digest_bucket(key: Column, buckets: int = 10) -> Column:
    """A bucket from the first nine hexadecimal digits of the key's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 9), 16, 10).cast("long") % buckets


def sample(reads: DataFrame, rate: float, key: Column) -> DataFrame:
    """A repeatable sample: buckets below ten times the rate. Rows with a null key go, unless the rate is 1."""
    n = tenths(rate)
    return reads if n == 10 else reads.filter(digest_bucket(key) < n)


def head(reads: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n records."""
    return reads.orderBy(*order).limit(n)


def every_other(reads: DataFrame, number: Column) -> DataFrame:
    """Records 0, 2, 4, ..."""
    return reads.filter(number % 2 == 0)
