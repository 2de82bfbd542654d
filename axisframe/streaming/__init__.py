"""Structured Streaming jobs for change events."""
