"""Structured Streaming jobs over messages."""
