"""Structured Streaming forms of the tile aggregates."""
