"""Structured Streaming jobs on frames."""
