"""Whole jobs: captures to tables."""

from vidlake.plans.channels import ChannelTables, channel_tables

__all__ = ["ChannelTables", "channel_tables"]
