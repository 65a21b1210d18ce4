"""Closed intervals, counted from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.ordered import running_max_before, running_sums


def islands(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """(key, start, end) of the union's parts; intervals that touch (start = end + 1) are one.

    Orders run over ranges, so a key of any size is shared by many tasks.
    """
    top = running_max_before(df.select(*key, start, end).distinct(), list(key), [start, end], end, "_m")
    numbered = running_sums(top, list(key), [start, end], {"_i": F.when(F.col("_m").isNull() | (F.col(start) > F.col("_m") + 1), 1).otherwise(0)})
    return numbered.groupBy(*key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def union_length(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """(key, covered): the length of the union. Each interval adds what lies beyond the furthest end before it, so one order does."""
    top = running_max_before(df.select(*key, start, end).distinct(), list(key), [start, end], end, "_m")
    beyond = F.col(end) - F.greatest(F.col(start) - 1, "_m")  # greatest takes no notice of a null
    return top.groupBy(*key).agg(F.sum(F.greatest(beyond, F.lit(0))).alias("covered"))


def density(df: DataFrame, key: Sequence[str], position: str, low: float, high: float, bins: int) -> DataFrame:
    """(key, bin, n): positions by equal-width bin, those beyond the ends in the outer bins; absent bins are left out."""
    width = (high - low) / bins
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(position) - low) / width))).cast("long")
    return df.groupBy(*key, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
