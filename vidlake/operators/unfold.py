"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: list[str], array: str | Column, at: str, value: str) -> DataFrame:
    """One row per element, its place from 0 in `at`; empty and missing arrays give none.

    For a plain explode Spark adds a filter on the array's size and pushes it down, where the
    array, here a parsed body, is computed a second time. The outer form has no such filter.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, value)).filter(
        F.col(at).isNotNull())
