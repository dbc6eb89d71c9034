"""Contiguous shards of near equal bytes, cut by a global running sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidlake.llm.columns import known_id, without
from vidlake.session import stage

SHARDS = 24
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: `doc_id`, `size`, `text_crc32`, `shard`, `slot`.

    Documents are ordered by id and dealt into ranges; sizes and checksums are taken at the scan,
    so that only narrow rows move. Each range is summed, the sums of earlier ranges (one row per
    partition) give every range its start, and a running sum inside the range gives each document
    its place in the bytes of the whole corpus. A document belongs to the shard that holds its
    middle byte, so a cut is off its target by half a document at most.

    A null text has no bytes. A null id counts as the largest and comes last; rows with equal
    ids stand in order of their checksum and size, equal rows in any order. No rows give no rows.
    Columns other than `doc_id` and `text` are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", known_id().alias("_id"),
                       (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_id", "text_crc32", "size"]
    ranged = stage(rows.repartitionByRange(width, *order)
                   .withColumn("_part", F.spark_partition_id()), "shard-ranges")
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"),
                                         F.count(F.lit(1)).alias("_rows"))
    # One row per partition from here to the join: that bounds the window and the broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding,
                                                Window.unboundedFollowing)
    starts = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(whole).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.withColumns({
        "_nth": F.row_number().over(inside),
        "_to": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.join(F.broadcast(starts), "_part").select(
        "doc_id", "size", "text_crc32", (F.col("_row0") + F.col("_nth") - 1).alias("_row"),
        F.least(F.lit(shards - 1), F.expr(
            f"(2 * (_byte0 + _to) - size) * {shards} div (2 * _total)")).cast("int")
        .alias("shard"))
    placed = stage(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`docs` with `shard` and `slot`, for writing; null ids match null ids."""
    places = byte_shards(docs, shards).select(
        F.col("doc_id").alias("_doc"), F.col("text_crc32").alias("_crc"),
        F.col("size").alias("_size"), "shard", "slot")
    nth = F.row_number().over(Window.partitionBy("_doc", "_crc", "_size").orderBy("shard", "slot"))
    text = F.coalesce("text", F.lit(""))
    rows = without(docs, "shard", "slot").withColumns({
        "_crc": F.crc32(F.encode(text, "UTF-8")),
        "_size": (F.octet_length(text) + F.lit(OVERHEAD)).cast("long")})
    # Equal documents are numbered on both sides, so that each takes a place of its own.
    rows = rows.withColumn("_nth", F.row_number().over(
        Window.partitionBy("doc_id", "_crc", "_size").orderBy("_crc")))
    places = places.withColumn("_nth", nth).withColumnsRenamed(
        {"_crc": "_crc2", "_size": "_size2", "_nth": "_nth2"})
    return rows.join(places, F.col("doc_id").eqNullSafe(F.col("_doc"))
                     & (F.col("_crc") == F.col("_crc2")) & (F.col("_size") == F.col("_size2"))
                     & (F.col("_nth") == F.col("_nth2"))).drop(
        "_doc", "_crc", "_size", "_nth", "_crc2", "_size2", "_nth2")
