"""From captures to tables of videos and comments, for all channels at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidlake import SOURCE
from vidlake.operators import comments as C
from vidlake.operators import discussion as D
from vidlake.operators import videos as V
from vidlake.operators.embedded import page_errors, read_pages
from vidlake.session import stage, staged


class ChannelTables(NamedTuple):
    videos: DataFrame
    comments: DataFrame
    #: Failures: of channels and videos by their pages, and by their responses.
    errors: DataFrame
    #: Announced number of comments per video whose page was captured.
    totals: DataFrame


def video_pages(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """First pages and video responses, parsed in one pass and staged; see `session.stage`."""
    return staged(V.parse_video_bodies(V.channel_responses(pages, responses)), "video-pages")


def video_table(pages: DataFrame, responses: DataFrame, max_videos: int | None = None,
                fill_first_page: bool = False) -> DataFrame:
    """Videos of all channels."""
    return V.videos(video_pages(pages, responses), max_videos, fill_first_page)


def comment_responses(responses: DataFrame, sort_by: int = C.SORT_RECENT) -> DataFrame:
    """Comment responses in one order, parsed in one pass and staged."""
    return staged(C.parse_comment_bodies(responses, sort_by), "comment-pages")


def channel_tables(
    pages: DataFrame,
    responses: DataFrame,
    max_videos: int | None = None,
    per_video_limit: int | None = None,
    sort_by: int = C.SORT_RECENT,
    strict: bool = False,
    source: str = SOURCE,
) -> ChannelTables:
    """Videos, the comments of those videos, what failed, and how many comments pages announce.

    A page whose data can be read yields its videos even if its settings cannot, since nothing
    is requested with them; the failure is listed all the same. Pages may carry a `retry_body`,
    see `discussion.video_facts`. The html of pages is read once, what it holds is staged;
    responses are read once for videos, once for comments and, the first of each video, once for
    totals. Places of responses are found from narrow columns, and records are unfolded last.
    """
    read = stage(read_pages(pages), "pages")
    listed = video_pages(read, responses)
    videos = stage(V.videos(listed, max_videos), "videos")
    parsed = comment_responses(responses, sort_by)
    numbered = C.number_responses(parsed, strict, videos, per_video_limit)
    watched = read.filter("video_id is not null and data is not null")
    retry = "retry_body" if "retry_body" in pages.columns else None
    facts = stage(D.video_facts(watched, sort_by, retry).select(
        "channel_ref", "video_id", "fetched_at", "comments_enabled", "page_total", "sort_error"),
        "facts")
    failed = ["channel_ref", "video_id", "error"]
    errors = page_errors(read).select(*failed)
    for more in (
        V.channel_errors(listed).withColumn("video_id", F.lit(None).cast("string")),
        C.video_errors(parsed),
        D.sort_failures(facts),
    ):
        errors = errors.unionByName(more.select(*failed))
    totals = D.comment_totals(facts, responses.filter("kind = 'comments'"), sort_by)
    return ChannelTables(videos, C.comments(numbered, per_video_limit, source), errors, totals)
