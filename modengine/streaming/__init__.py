"""Structured Streaming forms of the stateful rules and sinks."""
