"""Connected components of links between numbered things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake.session import stage


def components(links: DataFrame) -> DataFrame:
    """`links`: longs `a`, `b`, in any order. One row (`id`, `component`) for each id in a link,
    with the least id it reaches.

    Stars are formed in turns: first every id hands its larger neighbours to its least one, then
    its smaller ones, until nothing moves (a logarithmic number of turns in practice). A turn is
    two sums by id and joins with them; sums are staged, so that the join on the id of a hot star
    can be split.
    """
    edges = stage(_ordered(links.select("a", "b")), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        edges = stage(_ordered(both.join(least, "a").where("b > a").select("b", "m")), "links")
        least = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = edges.join(least, "a").select("b", "m").union(least.select("a", "m"))
        edges = stage(_ordered(small), "links")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
                       .distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, the larger id first."""
    x, y = links.columns
    return links.where(F.col(x) != F.col(y)).select(
        F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
