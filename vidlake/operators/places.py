"""The place of every response in its chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.operators.accumulate import accumulate
from vidlake.session import ROW_ID, stage

SEQ = "response_seq"


def placed(
    parsed: DataFrame,
    keys: list[str],
    count: str,
    stop: Column,
    stamp: str,
    cut: Column | None = None,
    limit: int | None = None,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Responses that count, with the number of records before them in their chain as `before`.

    `parsed` is a staged table of responses: `count` names its number of records, `stop` marks
    responses that end their chain and don't count themselves, `cut` those that end it but do.
    `scraped_at` becomes the chain's "min" or "max" time of capture, as `stamp` says. With
    `limit`, responses with that many records before them are left out. `lookup` is as in
    `accumulate`. Where a response was captured more than once, the latest capture counts.

    Only a few narrow columns are shuffled for this. Captures are reduced to the latest one
    before the shuffle as far as possible, so any number of copies costs little, and sums run
    over buckets, so any length of chain does. The wide rows are then picked by their row id:
    they are spread evenly whatever the chains look like, and not shuffled at all if Spark
    measures the picked places to be few, which is why limited ones are staged.
    """
    capture = F.struct(
        "fetched_at", ROW_ID, F.col(count).alias("_n"), stop.cast("int").alias("_stop"),
        (F.lit(False) if cut is None else cut).cast("int").alias("_cut"),
    )
    latest = parsed.groupBy(*keys, SEQ).agg(F.max(capture).alias("_c")).select(*keys, SEQ, "_c.*")
    sums = accumulate(
        latest, keys, SEQ,
        running={"_seen": F.col("_n"), "_stops": F.col("_stop"), "_cuts": F.col("_cut")},
        whole={"scraped_at": (stamp, F.col("fetched_at"))},
        lookup=lookup,
    )
    added = [] if lookup is None else [c for c in lookup.columns if c not in keys]
    places = sums.filter("_stops = 0 and _cuts = _cut").select(
        ROW_ID, (F.col("_seen") - F.col("_n")).alias("before"), "scraped_at", *added)
    if limit is not None:
        places = stage(places.filter(F.col("before") < limit), "places")
    return parsed.drop("fetched_at").join(places, ROW_ID).drop(ROW_ID)
