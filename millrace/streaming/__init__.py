"""Incremental processing of growing inputs with Structured Streaming."""
