"""Incremental processing of arriving files with Structured Streaming."""
