"""Sources: capture tables, folders of pages, channel lists."""

from vidlake.sources.captures import read_pages, read_page_files, read_responses, until_empty
from vidlake.sources.channels import parse_channel_lines, read_channel_list

__all__ = [
    "parse_channel_lines", "read_channel_list", "read_page_files", "read_pages",
    "read_responses", "until_empty",
]
