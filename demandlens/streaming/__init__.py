"""Structured Streaming form of the frequency counts."""

from demandlens.streaming.counts import annual_share_of, read_mentions, running_counts, read_published, start_running_counts

__all__ = ["annual_share_of", "read_mentions", "running_counts", "read_published", "start_running_counts"]
