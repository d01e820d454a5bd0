"""Structured Streaming versions of intake, queue counters and the attempt lifecycle."""
