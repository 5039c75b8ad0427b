"""Structured Streaming: idempotent ingestion and rates."""

from .stream import into_table, live_view, sliding_rate

__all__ = ["into_table", "live_view", "sliding_rate"]
