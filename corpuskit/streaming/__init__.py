"""Structured Streaming jobs. Each ``start_*`` returns the running query."""
