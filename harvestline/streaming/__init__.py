"""Structured Streaming versions of the feeds and views."""
