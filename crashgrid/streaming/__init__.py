"""Structured Streaming jobs and incremental refresh."""
