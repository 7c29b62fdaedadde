"""Spark-native passage retrieval, evaluation and corpus processing."""
