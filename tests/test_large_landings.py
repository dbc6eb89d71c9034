"""Streams whose files hold many responses."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from vidlake.schemas import RESPONSE_CAPTURES
from vidlake.streaming import (
    latest_totals,
    live_totals,
    read_landing,
    stream_comments,
    written_comments,
)


def _landed(spark, path: str, n: int):
    """One file of `n` responses, a comment of 6,400 letters each that do not compress well."""
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 256)
                      for i in range(100)])
    mutations = F.array(
        F.struct(F.struct(F.struct(
            F.struct(F.col("id").cast("string").alias("commentId"),
                     F.struct(text.alias("content")).alias("content"),
                     F.lit("now").alias("publishedTime"), F.lit("k").alias("toolbarStateKey"))
            .alias("properties"),
            F.struct(F.lit("a").alias("displayName"), F.lit("UC").alias("channelId"),
                     F.lit("p").alias("avatarThumbnailUrl")).alias("author"),
            F.struct(F.lit("1").alias("likeCountNotliked"), F.lit("0").alias("replyCount"))
            .alias("toolbar")).alias("commentEntityPayload")).alias("payload")))
    rows = spark.range(n).select(
        F.lit("@c").alias("channel_ref"), F.concat(F.lit("v"), F.col("id") % 3).alias("video_id"),
        F.lit("comments").alias("kind"), F.lit(1).alias("sort_by"),
        F.col("id").cast("int").alias("response_seq"),
        F.lit(None).cast("string").alias("request_token"),
        F.to_json(F.struct(F.struct(F.struct(mutations.alias("mutations"))
                                    .alias("entityBatchUpdate")).alias("frameworkUpdates")))
        .alias("body"), F.timestamp_seconds(F.lit(1700000000)).alias("fetched_at"))
    rows.coalesce(1).write.parquet(path)
    assert len(glob.glob(f"{path}/*.parquet")) == 1
    return read_landing(spark, path)


def _streamed(spark, start, landing, tmp_path) -> str:
    out = str(tmp_path / "out")
    job = start(landing, out, str(tmp_path / "state"))
    job.awaitTermination()
    return out


def _tasks(spark, out: str) -> int:
    """Tasks that had rows; those of empty splits write files without any."""
    return spark.read.parquet(out).select("_metadata.file_name").distinct().count()


def test_a_large_file_is_parsed_in_several_tasks(spark, tmp_path):
    landing = _landed(spark, str(tmp_path / "landing"), 2000)
    out = _streamed(spark, stream_comments, landing, tmp_path)
    assert _tasks(spark, out) > 1
    assert written_comments(spark, out) == 2000
    rows = spark.read.parquet(out)
    assert rows.select("video_id", "response_seq").distinct().count() == rows.count() == 2000


def test_totals_of_a_large_file_are_taken_in_several_tasks(spark, tmp_path):
    landing = _landed(spark, str(tmp_path / "landing"), 2000)
    out = _streamed(spark, live_totals, landing, tmp_path)
    assert _tasks(spark, out) > 1
    row = latest_totals(spark, out).first()
    assert (row.channel_ref, row.comments, row.characters) == ("@c", 2000, 2000 * 6400)


def test_a_small_file_stays_one_task(spark, tmp_path):
    landing = _landed(spark, str(tmp_path / "landing"), 5)
    out = _streamed(spark, stream_comments, landing, tmp_path)
    assert _tasks(spark, out) == 1
    assert written_comments(spark, out) == 5
