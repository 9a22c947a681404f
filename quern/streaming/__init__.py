"""Incremental builds on file streams."""
