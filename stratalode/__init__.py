"""Spark-native analytics over source-file and document corpora."""
