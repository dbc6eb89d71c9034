"""Column functions: text to numbers, references, names, human-readable figures, JSON search."""

from vidlake.functions.human import (
    batch_folder,
    format_bytes,
    format_duration,
    format_number,
    format_time,
    iso_utc,
    percent_text,
    round_exact,
)
from vidlake.functions.numbers import length_to_minutes, parse_comment_count, parse_view_count
from vidlake.functions.refs import (
    channel_ref,
    channel_videos_path,
    comments_file_name,
    safe_name,
    strip,
    video_comments_path,
    watch_url,
)
from vidlake.functions.sql import register

__all__ = [
    "batch_folder", "channel_ref", "channel_videos_path", "comments_file_name", "format_bytes",
    "format_duration", "format_number", "format_time", "iso_utc", "length_to_minutes",
    "parse_comment_count", "parse_view_count", "percent_text", "register", "round_exact",
    "safe_name", "strip", "video_comments_path", "watch_url",
]
