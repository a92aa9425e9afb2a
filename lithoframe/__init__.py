"""Spark-native text, retrieval, graph and evidence analytics."""

__version__ = "0.1.0"
