"""Spark-native knowledge-base and episode analytics."""
