"""Statistics of videos, channels and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidlake.functions.human import (
    batch_folder,
    format_bytes,
    format_duration,
    format_number,
    format_time,
    iso_utc,
    round_exact,
)

MB = 1024 * 1024
# Comments assumed per video where no limit is set; wording of the summary.
ESTIMATE_PER_VIDEO = 500
SUMMARY_PARTS = [
    "  Total Videos:   ", "  Total Comments: ", "  Total Data:     ", "  Total Time:     ",
]


def comments_per_video(comments: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Comments of each video; with `videos`, of exactly those, 0 where there are none."""
    keys = ["channel_ref", "video_id"]
    counts = comments.groupBy(*keys).agg(F.count("*").alias("comments"))
    if videos is None:
        return counts
    return videos.select(*keys).distinct().join(counts, keys, "left").select(
        *keys, F.coalesce("comments", F.lit(0)).alias("comments"))


def counted_comments(comments: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Comments per channel, those of failed videos left out.

    Comments are counted per video first, so the failures meet one row per video.
    """
    if failed is None:
        return comments.groupBy("channel_ref").agg(F.count("*").alias("comments"))
    keys = ["channel_ref", "video_id"]
    kept = comments_per_video(comments).join(
        failed.filter("video_id is not null").select(*keys), keys, "left_anti")
    return kept.groupBy("channel_ref").agg(F.sum("comments").alias("comments"))


def file_sizes(spark: SparkSession, path: str, per_video: bool = False) -> DataFrame:
    """Bytes per exported channel, or per video of an export with a folder for each.

    Taken from the files' listing; contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keys = ["channel_key", "video_key"] if per_video else ["channel_key"]
    return (
        files.select("length", *[
            F.regexp_extract("path", f"{key}=([^/]*)/", 1).alias(key) for key in keys])
        .groupBy(*keys).agg(F.sum("length").alias("bytes"))
    )


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def channel_stats(run_log: DataFrame, videos: DataFrame, comments: DataFrame,
                  sizes: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row per processed channel of a run: videos, comments, MB, seconds, status, error.

    `videos` and `comments` need only `channel_ref`, `sizes` has `channel_ref` and `bytes`. All
    three are aggregated before they are joined, so what meets is a row per channel. A channel
    without comments shows 0; a failed one shows zeros and its error. With `failed`, videos by
    `channel_ref` and `video_id`, the comments of those do not count, nor do their bytes where
    `sizes` has a `video_id`.
    """
    n_videos = videos.groupBy("channel_ref").agg(F.count("*").alias("_videos"))
    n_comments = counted_comments(comments, failed).withColumnRenamed("comments", "_comments")
    if failed is not None and "video_id" in sizes.columns:
        keys = ["channel_ref", "video_id"]
        sizes = sizes.join(failed.select(*keys).distinct(), keys, "left_anti")
    n_bytes = sizes.groupBy("channel_ref").agg(F.sum("bytes").alias("_bytes"))
    rows = run_log.withColumn("channel_ref", F.col("channel"))
    for side in (n_videos, n_comments, n_bytes):
        rows = rows.join(side, "channel_ref", "left")
    ok = F.col("status") == "ok"

    def if_ok(value: Column, zero) -> Column:
        return F.when(ok, F.coalesce(value, F.lit(zero))).otherwise(F.lit(zero))

    return rows.select(
        "run_id", "idx", "channel",
        if_ok(F.col("_videos"), 0).cast("bigint").alias("videos"),
        if_ok(F.col("_comments"), 0).cast("bigint").alias("comments"),
        if_ok(F.col("_bytes") / F.lit(float(MB)), 0.0).alias("bytes_mb"),
        if_ok(_seconds(F.col("started_at"), F.col("finished_at")), 0.0).alias("duration_sec"),
        "status", "error",
    )


def batch_report(channel_list: DataFrame, run_log: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per run; sums are over channels that did not fail, rounded after summing.

    The report's list of channels is the `stats` table itself: a run may have any number of
    channels, so they are never collected into one value.
    """
    ok = F.col("status") == "ok"
    totals = stats.groupBy("run_id").agg(
        F.count_if(ok).alias("channels_ok"),
        F.count_if(~ok).alias("channels_failed"),
        F.sum(F.when(ok, F.col("videos")).otherwise(0)).alias("total_videos"),
        F.sum(F.when(ok, F.col("comments")).otherwise(0)).alias("total_comments"),
        F.sum(F.when(ok, F.col("bytes_mb")).otherwise(0.0)).alias("_mb"),
    )
    span = run_log.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
    listed = channel_list.groupBy("run_id").agg(F.count("*").alias("channels_total"))
    return listed.join(span, "run_id", "left").join(totals, "run_id", "left").select(
        "run_id", batch_folder(F.col("started_at")).alias("folder"), "started_at", "finished_at",
        "channels_total",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in
          ("channels_ok", "channels_failed", "total_videos", "total_comments")],
        round_exact(F.coalesce("_mb", F.lit(0.0)), 2).alias("total_bytes_mb"),
        round_exact(F.coalesce(_seconds(F.col("started_at"), F.col("finished_at")), F.lit(0.0)),
                    1).alias("total_duration_sec"),
    )


def reported_channels(stats: DataFrame) -> DataFrame:
    """Channels as a report lists them: figures rounded, failed ones with status and error only."""
    ok = F.col("status") == "ok"
    return stats.select(
        "run_id", "idx", "channel",
        F.when(ok, F.col("videos")).alias("videos"),
        F.when(ok, F.col("comments")).alias("comments"),
        F.when(ok, round_exact(F.col("bytes_mb"), 2)).alias("bytes_mb"),
        F.when(ok, round_exact(F.col("duration_sec"), 1)).alias("duration_sec"),
        "status",
        F.when(~ok, F.col("error")).alias("error"),
    )


def channel_lines(channel_list: DataFrame, stats: DataFrame) -> DataFrame:
    """The line printed for each channel done, `[idx/total] channel — …`."""
    total = channel_list.groupBy("run_id").agg(F.count("*").alias("_total"))
    rows = stats.join(total, "run_id")
    head = F.format_string("[%d/%d] %s — ", F.col("idx"), F.col("_total"), F.col("channel"))
    done = F.concat(
        head, format_number(F.col("videos")), F.lit(" videos — "),
        format_number(F.col("comments")), F.lit(" comments — OK ("),
        format_bytes(F.col("bytes_mb") * MB), F.lit(", "),
        format_duration(F.col("duration_sec")), F.lit(")"),
    )
    failed = F.concat(head, F.lit("ERROR: "), F.col("error"))
    return rows.select(
        "run_id", "idx", F.when(F.col("status") == "ok", done).otherwise(failed).alias("line"))


def listed_channels(channel_list: DataFrame, run_log: DataFrame) -> DataFrame:
    """All listed channels with their outcome; those not reached have status NULL."""
    done = run_log.select("run_id", "idx", "status", "error")
    return channel_list.join(done, ["run_id", "idx"], "left")


def error_counts(failures: DataFrame) -> DataFrame:
    """Failures by message."""
    return failures.groupBy("error").agg(F.count("*").alias("failures"))


def error_log(run_log: DataFrame) -> DataFrame:
    """Lines `time | channel | message` of the failed channels."""
    return run_log.filter("status = 'failed'").select(
        "run_id", "idx",
        F.concat_ws(" | ", iso_utc(F.col("finished_at")), "channel",
                    F.coalesce("error", F.lit(""))).alias("line"),
    )


def dry_run(videos: DataFrame, per_video_limit: int | None = None) -> DataFrame:
    """What a run would fetch per channel; a video counts as having comments unless it says no."""
    has = F.col("has_comments") if "has_comments" in videos.columns else F.lit(True)
    each = per_video_limit or ESTIMATE_PER_VIDEO
    return videos.groupBy("channel_ref").agg(
        F.count("*").alias("videos"),
        F.count_if(F.coalesce(has, F.lit(True))).alias("videos_with_comments"),
    ).withColumn("estimated_comments", F.col("videos_with_comments") * each)


def final_summary(video_log: DataFrame) -> DataFrame:
    """The closing figures of a channel, as numbers and as text."""
    ok = F.col("status") == "ok"
    totals = video_log.groupBy("channel").agg(
        F.count_if(ok).alias("videos"),
        F.sum(F.when(ok, F.col("comments")).otherwise(0)).alias("comments"),
        F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("bytes"),
        F.sum("elapsed_sec").alias("elapsed"),
    )
    values = [format_number(F.col("videos")), format_number(F.col("comments")),
              format_bytes(F.col("bytes")), format_time(F.col("elapsed"))]
    return totals.withColumn("summary", F.concat_ws("\n", *[
        F.concat(F.lit(label), value) for label, value in zip(SUMMARY_PARTS, values)]))
