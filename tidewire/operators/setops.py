"""Set operations on rows and arrays that keep order information explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import as_col


def union_with_ordinal(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames by name; `ordinal` tells which frame a row came from."""
    numbered = [df.withColumn("ordinal", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def set_algebra(left: Column | str, right: Column | str) -> Column:
    """Shared, left-only and right-only members of two arrays."""
    a, b = as_col(left), as_col(right)
    return F.struct(
        F.array_intersect(a, b).alias("shared"),
        F.array_except(a, b).alias("only_left"),
        F.array_except(b, a).alias("only_right"),
        F.arrays_overlap(a, b).alias("overlaps"),
    )


def link_difference(captured: DataFrame, represented: DataFrame) -> DataFrame:
    """Distinct (edition, link) of the left side that the right side lacks."""
    return captured.select("edition", "link").distinct().join(
        represented.select("edition", "link"), ["edition", "link"], "left_anti"
    )


def ordered_distinct(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct keys with the position of their first row."""
    return df.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"))
