"""Running figures of a channel's videos while they are worked off, and of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidlake.functions.human import format_bytes, format_number, format_time, percent_text
from vidlake.operators.accumulate import accumulate

# A status line is shown for every fifth video and the last; no estimate is made
# from less than a second; wording.
STATUS_EVERY = 5
MIN_ELAPSED = 1.0
ALMOST_DONE = "almost done"
STATUS_PARTS = ["Videos: ", "Comments: ", "Data: ", "Time: ", "ETA: "]


def channel_progress(video_log: DataFrame) -> DataFrame:
    """Totals of a channel after each of its videos that did not fail.

    Adds `completed, total_comments, total_bytes, elapsed, percent, eta_sec`. Failed videos
    count towards the time passed only. The estimate is the mean time of a completed video
    times the videos not completed, NULL when none remain.
    """
    ok = F.col("status") == "ok"

    def if_ok(name: str) -> Column:
        return F.when(ok, F.col(name)).otherwise(F.lit(0))

    totals = accumulate(video_log, ["channel"], "order", {
        "completed": ok.cast("long"),
        "total_comments": if_ok("comments"),
        "total_bytes": if_ok("bytes"),
        "elapsed": F.col("elapsed_sec"),
        "_worked": if_ok("elapsed_sec"),
    }).filter(ok)
    left = F.col("total_videos") - F.col("completed")
    return totals.select(
        *[c for c in totals.columns if c != "_worked"],
        F.when(F.col("total_videos") > 0, F.col("completed") / F.col("total_videos") * 100)
        .otherwise(F.lit(0.0)).alias("percent"),
        F.when(left > 0, F.col("_worked") / F.col("completed") * left).alias("eta_sec"),
    )


def status_lines(progress: DataFrame) -> DataFrame:
    """The status line of every fifth video and the last one, if it did not fail."""
    shown = progress.filter(
        (F.col("order") % STATUS_EVERY == 0) | (F.col("order") == F.col("total_videos")))
    values = [
        F.format_string("%d/%d (%s)", F.col("completed"), F.col("total_videos"),
                        percent_text(F.col("percent"))),
        format_number(F.col("total_comments")),
        format_bytes(F.col("total_bytes")),
        format_time(F.col("elapsed")),
        format_time(F.col("eta_sec")),  # left out where there is no estimate
    ]
    line = F.concat_ws(" | ", *[
        F.concat(F.lit(label), value) for label, value in zip(STATUS_PARTS, values)])
    return shown.select("channel", "order", line.alias("line"))


def comment_progress(video_log: DataFrame, limit: int | None = None) -> DataFrame:
    """How far each video's comments have come.

    Adds `expected` (the limit, else the announced total), `percent`, `percent_text` and `eta`.
    There is no estimate before a second has passed, without comments or without an expected
    total.
    """
    expected = F.col("expected_total") if limit is None else F.lit(limit).cast("bigint")
    known = F.coalesce(F.col("expected"), F.lit(0)) > 0
    percent = F.when(known, F.col("comments") / F.col("expected") * 100)
    rate = F.col("comments") / F.col("elapsed_sec")
    left = F.col("expected") - F.col("comments")
    ready = known & (F.col("comments") > 0) & (F.col("elapsed_sec") >= MIN_ELAPSED)
    eta = F.when(ready & (left <= 0), F.lit(ALMOST_DONE)).when(ready, format_time(left / rate))
    return (
        video_log.withColumn("expected", expected)
        .withColumn("percent", percent)
        .withColumn("percent_text", percent_text(F.col("percent")))
        .withColumn("eta", eta)
    )


def until_failure(run_log: DataFrame) -> DataFrame:
    """Channels of each run up to and including its first failure.

    The first failure is an aggregate of the failed rows alone, partly computed before the
    shuffle, so no run is sorted or held in one task.
    """
    first = run_log.filter("status = 'failed'").groupBy("run_id").agg(
        F.min("idx").alias("_stop"))
    return run_log.join(first, "run_id", "left").filter(
        F.col("_stop").isNull() | (F.col("idx") <= F.col("_stop"))
    ).select(*run_log.columns)
