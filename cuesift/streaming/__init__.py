"""Structured Streaming forms of the incremental flows."""
