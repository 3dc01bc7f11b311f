"""Rows dealt to ranges of about equal size, for orders over a whole table that no task should sort alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def in_ranges(df: DataFrame, column: str, parts: int = RANGES) -> DataFrame:
    """df with ``_range``: 0 to parts - 1, ascending with the column, split at its quantiles; equal values share a range.

    The splitters come from a sketch over all rows: at most ``parts`` numbers, in one row that every task gets. Long
    tails and dense spots get ranges of their own, where equal steps would leave nearly all rows in a few.
    """
    marks = [i / parts for i in range(1, parts)]
    splits = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col(column), F.array(*[F.lit(m) for m in marks]), 10_000))).alias("_splits"))
    dealt = df.join(F.broadcast(splits), how="cross")  # one row
    return dealt.withColumn("_range", F.coalesce(F.size(F.filter("_splits", lambda s: s <= F.col(column))), F.lit(0))).drop("_splits")


def before_ranges(per_range: DataFrame, value: str, function=F.sum) -> DataFrame:
    """per_range (one row a range, at most RANGES) with ``_before``: the function of the value over all ranges before; null for the first."""
    return per_range.withColumn("_before", function(value).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
