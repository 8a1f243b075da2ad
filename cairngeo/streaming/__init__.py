"""Structured Streaming forms of the feed and delivery operators."""
