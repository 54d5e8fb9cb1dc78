"""Incremental forms of batch operators, as Structured Streaming jobs."""
