"""Spark-native analytics for retrieval-augmented question answering."""

__version__ = "0.1.0"
