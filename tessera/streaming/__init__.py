"""Structured Streaming upserts of the graph and chunk tables."""
