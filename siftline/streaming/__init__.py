"""Incremental deduplication of arriving files."""

from .incremental import stream_dedup, stream_records

__all__ = ["stream_dedup", "stream_records"]
