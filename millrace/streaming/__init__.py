"""Structured Streaming: push ingestion, live tails, run state."""
