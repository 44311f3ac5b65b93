"""Structured Streaming: replay, scoring in micro-batches, event-time operators."""
