"""Spark-native profiling of document archives."""
