"""Structured Streaming forms of the append-only logs. These are this engine's own additions."""
