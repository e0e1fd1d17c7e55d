"""Structured Streaming: near-real-time ingestion and windows over event streams."""

from .events import dedup_within, session_counts, stateful_totals, tumbling_counts
from .ingest import ingest_stream

__all__ = ["dedup_within", "ingest_stream", "session_counts", "stateful_totals", "tumbling_counts"]
