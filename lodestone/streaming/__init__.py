"""Structured Streaming operators: feeds, novelty filters and expiring proposals."""
