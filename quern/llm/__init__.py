"""Operators for large-scale training-data pipelines (packing, quality, scoring, dedup, tokens...)."""
