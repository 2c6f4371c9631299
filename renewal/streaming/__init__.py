"""Structured Streaming: incremental scoring of arriving test rows (see ``scoring``)."""

from renewal.streaming.scoring import scored_stream, start_scoring

__all__ = ["scored_stream", "start_scoring"]
