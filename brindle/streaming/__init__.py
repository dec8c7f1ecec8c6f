"""Mergeable summaries kept up by Structured Streaming."""
