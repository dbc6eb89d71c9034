"""References, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms a channel reference takes, and the address of a video.
HANDLE_URL = r"youtube\.com/@([a-zA-Z0-9_-]+)"
CHANNEL_URL = r"youtube\.com/channel/(UC[a-zA-Z0-9_-]+)"
CHANNEL_PATH = r"^/?channel/(UC[a-zA-Z0-9_-]+)"
CHANNEL_ID = r"^UC[a-zA-Z0-9_-]+\z"
WATCH_URL = "https://www.youtube.com/watch?v="

#: File extensions by export format; JSON is the default for anything else.
EXTENSIONS = {"csv": "csv", "parquet": "parquet"}

_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space, Unicode blanks and line breaks included."""
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def channel_ref(text: Column) -> Column:
    """Channel reference in a line of text: a handle or a channel id, NULL if there is none."""
    t = strip(text)
    return F.coalesce(
        F.when(t.startswith("@"), t),
        F.concat(F.lit("@"), _group(t, HANDLE_URL)),
        _group(t, CHANNEL_URL),
        _group(t, CHANNEL_PATH),
        F.when(t.rlike(CHANNEL_ID), t),
    )


def safe_name(name: Column) -> Column:
    """A reference as a folder name: `@` dropped, slashes of both kinds turned into `_`."""
    return F.translate(name, "/\\@", "__")


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), video_id)


def comments_file_name(order: Column, video_id: Column, fmt: str = "jsonl") -> Column:
    """`NNNN_<id>.<ext>`; numbers beyond four digits are kept whole."""
    number = order.cast("string")
    # Padding alone would cut longer numbers.
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(padded, F.lit("_"), video_id, F.lit("." + EXTENSIONS.get(fmt, "jsonl")))


def channel_videos_path(channel: Column, base: str = "data", fmt: str = "json") -> Column:
    ext = EXTENSIONS.get(fmt, "json")
    return F.concat(F.lit(f"{base}/"), safe_name(channel), F.lit(f"/videos.{ext}"))


def video_comments_path(video_id: Column, base: str = "data", fmt: str = "jsonl") -> Column:
    """Where the comments of a single video go when they are exported on their own."""
    ext = EXTENSIONS.get(fmt, "jsonl")
    return F.concat(F.lit(f"{base}/"), safe_name(video_id), F.lit(f"/comments.{ext}"))
