"""Indexing from streams."""
