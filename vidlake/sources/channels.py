"""Lists of channels, one reference per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidlake.functions.refs import channel_ref, strip


def parse_channel_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Add `channel` and `reject` to lines, dropping blank ones and those starting with `#`.

    `reject` holds the text of a line without a reference. Order and duplicates are kept.
    """
    stripped = lines.withColumn("_line", strip(F.col(text)))
    kept = stripped.filter((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    parsed = kept.withColumn("channel", channel_ref(F.col("_line")))
    return parsed.withColumn(
        "reject", F.when(F.col("channel").isNull(), F.col("_line"))
    ).drop("_line")


def read_channel_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number from 1: `file, line_number, channel, reject`.

    A file larger than a split is read by several tasks. Lines are numbered within their split
    and shifted by the lines of the splits before it, so no task holds a whole file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("text"),
    )
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("_lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(
        "file", "block", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file", "block").orderBy("_at")
    numbered = (
        raw.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["file", "block"])
        .select("file", (F.col("_start") + F.col("_row")).alias("line_number"), "text")
    )
    return parse_channel_lines(numbered).select("file", "line_number", "channel", "reject")
