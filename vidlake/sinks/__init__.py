"""Sinks: comments and videos as JSON, CSV or Parquet; batch reports."""

from vidlake.sinks.documents import videos_json_lines, write_report, write_videos_json
from vidlake.sinks.tables import export_comments, export_videos

__all__ = [
    "export_comments", "export_videos", "videos_json_lines", "write_report", "write_videos_json",
]
