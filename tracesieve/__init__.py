"""Spark-native analytics over diagnostic logs, source text and message corpora."""
__version__ = "0.1.0"
