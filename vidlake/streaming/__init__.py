"""The comment extraction on a landing folder, with Structured Streaming."""

from vidlake.streaming.live import (
    Progress,
    landed_comments,
    latest_totals,
    live_totals,
    read_landing,
    stream_comments,
    written_comments,
)

__all__ = [
    "Progress", "landed_comments", "latest_totals", "live_totals", "read_landing",
    "stream_comments", "written_comments",
]
