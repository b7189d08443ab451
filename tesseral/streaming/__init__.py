"""Structured Streaming counterparts of the batch patterns."""
