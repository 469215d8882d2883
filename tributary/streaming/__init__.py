"""Pipelines over streams: the stateless operators as they are, windowed aggregates and deduplication with watermarks."""

from .streams import STATELESS, deduplicated, plan_stream, read_stream, windowed, write_stream

__all__ = ["STATELESS", "deduplicated", "plan_stream", "read_stream", "windowed", "write_stream"]
