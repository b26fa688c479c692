"""Readers and writers for sharded study data."""
