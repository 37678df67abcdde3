"""Spark-native analytics for document-similarity graphs and graph-based retrieval."""
