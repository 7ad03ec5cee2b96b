"""Spark-first text-privacy analytics."""
