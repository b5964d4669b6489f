"""Spark-native semantic search and MapReduce analytics engine."""
