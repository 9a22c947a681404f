"""Readers and writers of row files, matrices and records."""
