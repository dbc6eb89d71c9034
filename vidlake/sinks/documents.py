"""JSON documents of any size, written as lines.

A document with a list of unknown length (videos of a channel, channels of a run) is never
built as one value. Its lines are rows: an opening, one element each, a closing. They are
spread by ranges, sorted and written as text; the files of a folder, taken in the order of
their names, are the document.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vidlake import SOURCE
from vidlake.functions.human import iso_utc
from vidlake.functions.refs import safe_name
from vidlake.operators.stats import error_log, reported_channels
from vidlake.schemas import VIDEO_FIELDS

_STATS = ["channel", "videos", "comments", "bytes_mb", "duration_sec", "status", "error"]


def _json(value: Column) -> Column:
    """Any value as JSON text, NULL as `null`."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _members(pairs: list[tuple[str, Column]], indent: int, skip_null: bool = False) -> Column:
    pad = " " * indent
    parts = []
    for name, value in pairs:
        line = F.concat(F.lit(f'{pad}"{name}": '), _json(value))
        parts.append(F.when(value.isNotNull(), line) if skip_null else line)
    return F.concat_ws(",\n", *parts)


def _document(heads: DataFrame, elements: DataFrame, key: str, first: list[str],
              opening: Column, closing: Column, at: str, body: Column) -> DataFrame:
    """Lines `(key, part, at, line)`: part 0 opens, 1 holds elements, 2 closes.

    An element's line ends the element before it, the closing ends the last, so only the first
    element must be known: the columns `first` tell it from all others, and in `heads` their
    struct `_first` has its values. Elements meet it by all of these columns, never by the key
    of the document alone, so that a document of any length is spread evenly.
    """
    head = heads.select(
        key, F.explode(F.array(
            F.struct(F.lit(0).alias("part"), opening.alias("line")),
            F.struct(F.lit(2).alias("part"), closing.alias("line")),
        )).alias("_x")
    ).select(key, "_x.part", F.lit(0).cast("bigint").alias("at"), "_x.line")
    head = head.filter("line is not null")
    begins = heads.filter("_first is not null").select(
        *[F.col("_first")[c].alias(c) for c in first], F.lit(True).alias("_begins"))
    lines = elements.join(begins, first, "left").select(
        key, F.lit(1).alias("part"), F.col(at).cast("bigint").alias("at"),
        F.concat(F.when(F.col("_begins"), F.lit("")).otherwise(F.lit("    },\n")),
                 F.lit("    {\n"), body).alias("line"))
    return head.unionByName(lines)


def _around(members: Column, name: str, size: Column, rest: Column | None) -> tuple:
    """Opening and closing of a document whose list `name` stands last or before `rest`."""
    empty = F.coalesce(size, F.lit(0)) == 0
    tail = F.lit("\n}") if rest is None else F.concat(F.lit(",\n"), rest, F.lit("\n}"))
    opening = F.concat(F.lit("{\n"), members, F.lit(f',\n  "{name}": ['),
                       F.when(empty, F.concat(F.lit("]"), tail)).otherwise(F.lit("")))
    closing = F.when(~empty, F.concat(F.lit("    }\n  ]"), tail))
    return opening, closing


def videos_json_lines(videos: DataFrame, source: str = SOURCE,
                      channels: DataFrame | None = None) -> DataFrame:
    """The videos document of every channel as `(channel_key, part, at, line)`.

    `channels` lists channels by `channel_ref` and `scraped_at` that get a document even if
    they have no video.
    """
    first = ["channel_key", "order", "channel_ref", "video_id"]
    rows = videos.withColumn("channel_key", F.coalesce(safe_name(F.col("channel_ref")), F.lit("")))
    heads = rows.groupBy("channel_key").agg(
        F.count("*").alias("total"), F.max("channel_ref").alias("channel_ref"),
        F.max("scraped_at").alias("scraped_at"), F.min(F.struct(
            "order", "channel_ref", "video_id", "channel_key")).alias("_first"))
    if channels is not None:
        listed = channels.groupBy("channel_ref").agg(F.max("scraped_at").alias("_at"))
        heads = listed.join(heads, "channel_ref", "full_outer").select(
            F.coalesce("channel_key", safe_name(F.col("channel_ref")), F.lit(""))
            .alias("channel_key"), "channel_ref",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("scraped_at", "_at").alias("scraped_at"), "_first")
    opening, closing = _around(
        _members([("channel_id", F.col("channel_ref")), ("total_videos", F.col("total"))], 2),
        "videos", F.col("total"),
        _members([("scraped_at", iso_utc(F.col("scraped_at"))), ("source", F.lit(source))], 2))
    body = _members([(c, F.col(c)) for c in VIDEO_FIELDS], 6)
    return _document(heads, rows, "channel_key", first, opening, closing, "order", body)


def _write_lines(lines: DataFrame, key: str, path: str) -> int:
    """Write documents in order of their lines; returns the number of their elements."""
    columns = [F.col(key), F.col("part"), F.col("at")]
    counted = Observation("elements")
    # Counted after the exchange: what stands below it also runs for its sample.
    (
        lines.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .observe(counted, F.count_if(F.col("part") == 1).alias("rows"))
        .select(key, "line")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key).text(path)
    )
    return counted.get["rows"]


def write_videos_json(videos: DataFrame, path: str, source: str = SOURCE,
                      channels: DataFrame | None = None) -> int:
    """Write one indented JSON document per channel; returns the number of videos."""
    return _write_lines(videos_json_lines(videos, source, channels), "channel_key", path)


def report_lines(report: DataFrame, stats: DataFrame) -> DataFrame:
    """The report document of every run as `(run_id, part, at, line)`."""
    channels = reported_channels(stats)
    heads = report.join(
        stats.groupBy("run_id").agg(F.min(F.struct("idx", "run_id")).alias("_first")), "run_id",
        "left",
    ).withColumn("run_id", F.coalesce("run_id", F.lit("")))
    figures = ["channels_total", "channels_ok", "channels_failed", "total_videos",
               "total_comments", "total_bytes_mb", "total_duration_sec"]
    opening, closing = _around(_members(
        [("started_at", iso_utc(F.col("started_at"))),
         ("finished_at", iso_utc(F.col("finished_at")))]
        + [(c, F.col(c)) for c in figures], 2), "stats",
        F.when(F.col("_first").isNotNull(), F.lit(1)), None)
    body = _members([(c, F.col(c)) for c in _STATS], 6, True)
    return _document(heads, channels, "run_id", ["run_id", "idx"], opening, closing, "idx", body)


def write_report(channel_list: DataFrame, run_log: DataFrame, report: DataFrame,
                 stats: DataFrame, path: str) -> None:
    """Write the report, the error log and a copy of the channel list of every run."""
    _write_lines(report_lines(report, stats), "run_id", os.path.join(path, "report"))
    for name, rows in (
        ("errors", error_log(run_log)),
        ("channels", channel_list.select("run_id", "idx", F.col("channel").alias("line"))),
    ):
        lines = rows.select(
            F.coalesce("run_id", F.lit("")).alias("run_id"), F.lit(1).alias("part"),
            F.col("idx").cast("bigint").alias("at"), "line")
        _write_lines(lines, "run_id", os.path.join(path, name))
