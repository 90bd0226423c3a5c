"""Incremental versions on Structured Streaming."""

from .revision_stream import activity, follow_revisions, store_revisions

__all__ = ["activity", "follow_revisions", "store_revisions"]
