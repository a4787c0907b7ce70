"""Structured Streaming forms of the engine."""
