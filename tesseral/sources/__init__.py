"""Readers, the session catalog and copy-on-write tables."""
