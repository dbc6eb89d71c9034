"""Running figures over a key of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key are cut into buckets of 2**BUCKET_BITS positions.
BUCKET_BITS = 12
_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}


def accumulate(
    df: DataFrame,
    keys: list[str],
    position: str,
    running: dict[str, Column],
    whole: dict[str, tuple[str, Column]] | None = None,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Add running sums over `keys` in the order of the integer column `position`.

    `running` names the sums (each includes the row itself); `whole` names aggregates over the
    entire key, given as ("sum" | "min" | "max", column). `lookup` is a table joined on those of
    its columns that are keys: its other columns are added, rows without a match are dropped,
    rows with several repeated. Keys must not be NULL.

    A plain window would sort all rows of a key in one task. Here a key is cut into buckets of
    4,096 positions: rows are summed within their bucket, buckets (partly aggregated before
    they are shuffled, so some thousand times fewer) are summed per key, and the two are added.
    Rows are shuffled once, by key and bucket, so a key holding most of the data is spread over
    as many tasks as it has buckets. The lookup meets the sums of buckets, not the rows, which
    are sorted once for both the sums and the join.
    """
    whole = whole or {}
    rows = df.withColumn("_bucket", F.shiftright(F.col(position), BUCKET_BITS))

    buckets = rows.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(name) for name, c in running.items()],
        *[_AGGREGATES[how](c).alias(name) for name, (how, c) in whole.items()],
    )
    before = (
        Window.partitionBy(*keys).orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    every = Window.partitionBy(*keys)
    starts = buckets.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_start_{name}")
          for name in running],
        *[_AGGREGATES[how](name).over(every).alias(name) for name, (how, _) in whole.items()],
    )
    added = []
    if lookup is not None:
        added = [c for c in lookup.columns if c not in keys]
        starts = starts.join(lookup, [c for c in lookup.columns if c in keys])
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.select(
        "*", *[F.sum(c).over(inside).alias(f"_inner_{name}") for name, c in running.items()]
    )
    how = "left" if lookup is None else "inner"
    return summed.join(starts, [*keys, "_bucket"], how).select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_inner_{name}") + F.col(f"_start_{name}")).alias(name) for name in running],
        *[F.col(name) for name in (*whole, *added)],
    )
